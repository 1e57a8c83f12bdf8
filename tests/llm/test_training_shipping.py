from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cluster import counts


def test_operators_run_on_executors_without_the_package(sf, tmp_path):
    names = ["op1_near_dedup", "op3_sentencepiece", "op4_toxicity", "op5_warc", "op6_url_filter", "op8_suffix_dedup", "op9_packing", "op10_html_text"]
    found = counts(names, sf, tmp_path, 500)
    assert found["op1_near_dedup"] == found["op3_sentencepiece"] == found["op4_toxicity"] == found["op8_suffix_dedup"] == 200
    assert found["op5_warc"] == found["op6_url_filter"] == found["op10_html_text"] == 50
    assert found["op9_packing"] >= 200
