import numpy as np
import pandas as pd

from hitweave.llm import suffix_dedup
from hitweave.llm.suffix_dedup import Block


def test_owners_of_runs_are_found_without_a_search_a_byte(monkeypatch):
    """Empty and short texts between others, and cuts every few starts."""
    texts = ["", None, "a" * 49, "bcdefghij" * 12, "", "", "k" * 14, "lmnopqr" * 19, "", "xy" * 25, ""]
    monkeypatch.setattr(suffix_dedup, "STRIDE", 64)
    asked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **k: asked.append(np.size(v)) or search(a, v, **k))
    block = Block(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}), 50)
    assert len(block.first) and max(asked) <= 2
    assert block.owner.tolist() == search(block.ends, block.first, side="right").tolist()
    assert (block.last + 50 <= block.ends[block.owner]).all()
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(block.first, block.last)])
    assert covered.tolist() == [i for i in range(len(block.data) - 49) if i + 50 <= block.ends[search(block.ends, i, side="right")]]
