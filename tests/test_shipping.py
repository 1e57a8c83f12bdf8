from __future__ import annotations

from cluster import counts


def test_python_stages_run_on_executors_without_the_package(sf, tmp_path):
    """Every core query whose plan has Python workers."""
    names = ["segments_by_gap_and_tokens", "dedup_ring_buffer", "grip_extract", "topic_clusters", "topic_merge", "topic_model_labels", "embedded_texts", "model_rerank", "vector_index_search", "stream_segments"]
    found = counts(names, sf, tmp_path)
    assert set(found) == set(names)
    assert all(n > 0 for n in found.values())
