"""loreweave.operators"""
