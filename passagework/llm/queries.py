"""The registered queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> (module, function).
PLACES = {
    "op1_bpe": ("bpe", "op1_bpe"),
    "op2_quality": ("quality", "op2_quality"),
    "op3_chat": ("chat", "op3_chat"),
    "op4_topk": ("topk", "op4_topk"),
    "op5_packing": ("packing", "op5_packing"),
    "op6_lattice": ("lattice", "op6_lattice"),
    "op7_minhash": ("minhash", "op7_minhash"),
    "op8_substring": ("substring", "op8_substring"),
    "op9_toxicity": ("toxicity", "op9_toxicity"),
    "op10_langid": ("langid", "op10_langid"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, (module, function) in PLACES.items()}


def oracle_sql() -> dict[str, str]:
    from .topk import SQL

    return {"op4_topk": SQL}
