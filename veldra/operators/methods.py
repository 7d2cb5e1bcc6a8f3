"""Named retrieval methods: which index, retriever, number of hits and features a method name stands for."""

from __future__ import annotations

from dataclasses import dataclass

CHUNK_SIZE, CHUNK_OVERLAP = 512, 50
BASE_K, SECTION_K = 5, 12
HYBRID_POOL, HYBRID_K, RRF_K = 30, 12, 60
GRAPH_SEEDS, GRAPH_DEPTH, GRAPH_CAP, GRAPH_K = 6, 2, 6, 12
HYBRID_GRAPH_SEEDS, HYBRID_GRAPH_K = 10, 12
EDGE_PRIORITY = ("part", "sibling", "chapter", "statute")
REWRITE_SUFFIX = "_qfi"

#: The method where none is named.
DEFAULT = "section_v1"
#: Methods on offer with what they do, the recommended one first.
CATALOG = [
    (DEFAULT, "sections, by meaning", True),
    ("baseline", "fixed windows, by meaning", False),
    ("hybrid_section_v1", "sections, by meaning and by words", False),
    ("section_v1_qfi", "sections, by meaning, question translated first", False),
    ("hybrid_graph_section_v1", "sections, by meaning, words and neighbourhood", False),
    ("hybrid_section_v1_qfi", "sections, by meaning and by words, question translated first", False),
]
#: What the beginning of a name decides, the first that fits: retriever, hits, index (``{}``: the rest of the name).
ROUTES = (
    ("hybrid_graph_section_", "hybrid_graph", HYBRID_GRAPH_K, "section_{}"),
    ("hybrid_graph_", "hybrid_graph", HYBRID_GRAPH_K, "section_{}"),
    ("hybrid_graph", "hybrid_graph", HYBRID_GRAPH_K, "section_v1"),
    ("graph_", "graph", GRAPH_K, "section_{}"),
    ("graph", "graph", GRAPH_K, "section_v1"),
    ("hybrid", "hybrid", HYBRID_K, "section_v1"),
    ("section", "dense", SECTION_K, "section{}"),
    ("", "dense", BASE_K, "{}"),
)


@dataclass(frozen=True)
class Method:
    """What a method name means."""

    name: str
    index: str
    retriever: str
    top_k: int
    rewrites: bool
    hybrid_features: bool
    chunker: str


def resolve(name: str) -> Method:
    """The meaning of ``name``, longest prefix first; the rewrite suffix changes neither index nor retriever."""
    rewrites = name.endswith(REWRITE_SUFFIX)
    base = name.removesuffix(REWRITE_SUFFIX)
    for prefix, retriever, k, index in ROUTES:
        rest = base.removeprefix(prefix)
        if base.startswith(prefix) and (rest or not prefix.endswith("_")):
            chunker = "section" if base.startswith(("section", "graph")) else "baseline"
            return Method(name, index.format(rest), retriever, k, rewrites, retriever.startswith("hybrid"), chunker)
    raise AssertionError("the last route takes every name")
