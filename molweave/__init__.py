"""Fingerprints of labelled graph pairs, above all chemical reactions, on PySpark."""

from molweave.operators.similarity import equal_share as jaccard_minhash
from molweave.operators.similarity import tanimoto
from molweave.plans.engine import Encoder, FingerprintConfig, Result, describe, fingerprint, fingerprint_bits, fingerprint_graphs, fingerprint_strings, register_sketch, register_tokenizer, results
from molweave.sources.rsmi import read_rsmi
from molweave.sources.tables import from_dicts, from_networkx, from_printout, to_dicts, to_networkx, write_fingerprints

__all__ = [
    "Encoder", "FingerprintConfig", "Result", "describe", "fingerprint", "fingerprint_bits", "fingerprint_graphs", "fingerprint_strings", "from_dicts", "from_networkx", "from_printout",
    "jaccard_minhash", "read_rsmi", "register_sketch", "register_tokenizer", "results", "tanimoto", "to_dicts", "to_networkx", "write_fingerprints",
]

__version__ = "0.2.0"
