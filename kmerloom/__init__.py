"""A Spark-native engine for sequence sketches and distances.

read_sequences -> sketch -> triangle, dist or three; see the README for the whole.
"""

from .functions.params import SketchParams
from .operators.distance import all_pairs, dist, linked_pairs, measured, near_pairs, pairs_between, three, triangle
from .operators.kmers import kmers, kmers_by_columns
from .operators.mutants import mutate
from .operators.sketch import Sketches, nested, pooled_sketch, sketch
from .operators.trees import robinson_foulds
from .plans.reports import info
from .sources.sequences import read_sequences
from .sources.sketchfiles import write_sketch_files
from .sources.store import read_sketches, read_store, resolve_inputs, write_store

__all__ = [
    "SketchParams", "Sketches", "all_pairs", "dist", "info", "kmers", "kmers_by_columns", "linked_pairs", "measured", "mutate", "near_pairs",
    "nested", "pairs_between", "pooled_sketch", "read_sequences", "read_sketches", "read_store", "resolve_inputs", "robinson_foulds", "sketch", "three", "triangle",
    "write_sketch_files", "write_store",
]
