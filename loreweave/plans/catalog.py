"""Imports every query module so that it registers itself."""

from loreweave.plans import q_assembly, q_content, q_dashboard, q_evidence, q_graph, q_library, q_material, q_nodes, q_paths, q_places, q_retrieval, q_streaming, q_wiki  # noqa: F401
