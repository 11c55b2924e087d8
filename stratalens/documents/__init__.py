"""Hierarchical documents as tables of nodes: reading, walking, searching, comparing, describing, converting."""
