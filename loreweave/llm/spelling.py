"""Groups of spelling variants: words one edit apart, and the common form each follows.

Words are counted in the tasks that read the texts, with bounded memory. Pairs
one edit apart are found by an even-partition pigeonhole join. An indexed word of
length l is cut into two segments, l // 2 and the rest long. A partner of equal
length or one longer that is one edit away leaves one of the two unchanged: the
first at its start, or the second at its end, shifted by the difference in
length. So a word gives two index rows and, for the lengths l and l - 1, four
probe rows, and pairs meet on (length, segment, substring).

A substring that many words share would bring all their pairs together. Such a
key is split again in the same way: what is left of both words is one edit
apart as well, and is cut into two segments that lengthen the key. That goes on
until no key holds more than ``PAIRS`` candidates or one character is left to
compare, where letters bound the words of a key. No pair is lost. Candidates that
both segments find are one, and ``levenshtein`` verifies what is left of both.

A form's count is at least twice its word's, so paths to the root are short
(the logarithm of the largest count) and pointer doubling ends in few rounds.

Defined cases: a null text has no words; a null identifier writes nothing
before the colon; repeated rows count each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import slices, spread_join, staged, texts_of
from loreweave.llm.resample import CRC, CRC_TABLE

#: Lowers A-Z in UTF-8.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Distinct words that a task holds before it hands them on.
HELD = 400_000
#: Candidates of one key beyond which it is split.
PAIRS = 4096


def word_counts(docs: DataFrame, least_chars: int, least_count: int, spoiled: int = 97) -> DataFrame:
    """``word, n``: runs of letters over all texts, with one in ``spoiled`` (document, run) pairs short of a character."""

    def run(batches):
        found, seen = re.compile("[a-zÀ-ÿ]+").findall, Counter()

        def handed():
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()

        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                start = crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(found(text.encode().translate(LOWER).decode())).items():
                    h = crc32(word.encode(), start)
                    if h % spoiled == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_chars:
                        seen[word] += n
                if len(seen) >= HELD:
                    yield from handed()
        yield from handed()

    counted = texts_of(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _cut(rows: DataFrame) -> DataFrame:
    """Two rows for each: a segment of the index length goes from ``rest`` to ``key``.

    ``longer`` is null for index rows and the word's surplus over the index
    length for probe rows.
    """
    size = F.char_length("rest") - F.coalesce("longer", F.lit(0))
    first = F.floor(size / 2).cast("int")
    last = (size - first).cast("int")
    after = F.char_length("rest") - last
    taken = lambda at, n: F.substring(F.col("rest"), at, n)
    ends = F.array(
        F.struct(F.concat("key", F.lit("\x01"), taken(F.lit(1), first)).alias("key"), taken(first + 1, F.char_length("rest") - first).alias("rest")),
        F.struct(F.concat("key", F.lit("\x02"), taken(after + 1, last)).alias("key"), taken(F.lit(1), after).alias("rest")),
    )
    return rows.select("word", "n", "longer", F.explode(ends).alias("e")).select("word", "n", "longer", "e.key", "e.rest")


def segments(words: DataFrame) -> DataFrame:
    """Index and probe rows of the first cut: ``word, n, longer, key, rest``."""
    roles = F.explode(F.array(F.lit(None).cast("int"), F.lit(0), F.lit(1)))
    rows = words.select("word", "n", roles.alias("longer"))
    length = F.char_length("word") - F.coalesce("longer", F.lit(0))
    return _cut(rows.select("word", "n", "longer", F.concat(length.cast("string"), F.lit(":")).alias("key"), F.col("word").alias("rest")))


def near_links(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """``word, near, near_n``: both directions of every pair one edit apart; a pair may repeat."""
    rows, found = segments(words), []
    while True:
        rows = staged(rows, "segments")
        index = F.col("longer").isNull()
        sizes = rows.groupBy("key").agg(F.sum(index.cast("long")).alias("a"), F.sum((~index).cast("long")).alias("b"), F.max(F.when(index, F.char_length("rest"))).alias("left"))
        # a word meets itself with length equal: two rows of one word are no pair
        met = staged(sizes.filter("a > 0 and b > 0 and a + b > 2").select("key", ((F.col("a") * F.col("b") > pairs) & (F.col("left") > 1)).alias("hot")), "keys")
        rows_ = rows.join(met, "key")
        cool, hot = rows_.filter("not hot").drop("hot"), rows_.filter("hot").drop("hot")
        i = cool.filter(index).select("key", F.col("word").alias("s"), F.col("n").alias("sn"), F.col("rest").alias("sr"))
        p = cool.filter(~index).select("key", F.col("word").alias("r"), F.col("n").alias("rn"), F.col("rest").alias("rr"), "longer")
        one = (F.col("longer") == 1) | (F.col("s") < F.col("r"))
        near = i.join(p, "key").filter(one & (F.levenshtein("sr", "rr", 1) == 1))
        both = F.explode(F.array(F.struct(F.col("s").alias("word"), F.col("r").alias("near"), F.col("rn").alias("near_n")), F.struct(F.col("r").alias("word"), F.col("s").alias("near"), F.col("sn").alias("near_n"))))
        found.append(staged(near.select(both.alias("e")).select("e.*"), "near"))
        if met.filter("hot").isEmpty():
            break
        rows = _cut(hot)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each (word, form): forms followed to the last, in doubling steps."""
    steps = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(ahead, "root", "left_semi")
        if moved.isEmpty():
            return steps
        on = spread_join(moved, ahead, "root").select("word", F.col("next").alias("root"))
        steps = staged(steps.join(ahead, "root", "left_anti").select("word", "root").unionByName(on), "roots")


def variants(words: DataFrame, factor: int = 2, pairs: int = PAIRS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (a written table of word and n)."""
    links = near_links(words, pairs)
    # one deal by word serves the removal of repeated pairs, the counts and the best form
    single = links.repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    best = single.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("b"))
    whole = words.join(best, "word", "left")
    takes = -F.col("b.k") >= factor * F.col("n")
    formed = staged(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("b.near")).alias("form"), F.when(takes, -F.col("b.k")).alias("form_n")), "forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: variants among the words of all documents."""
    words = staged(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), 5, 3), "words")
    return variants(words)


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
grouped AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS f, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {CRC} AS h FROM grouped, crc_table),
spoiled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS short FROM shorter),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.short = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.short = w.word),
best AS (SELECT word, n, near AS form, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN form END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (word)),
walked AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT w.word, f.word, f.form FROM walked w JOIN formed f ON w.next = f.word)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walked w ON f.word = w.word WHERE w.next IS NULL
"""
