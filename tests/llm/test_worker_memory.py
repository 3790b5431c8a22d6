"""What a Python worker holds: the pipeline ended at an executor's memory in near_copies."""

import tracemalloc

import pyarrow as pa
import pytest

from barloom.llm import common, parity_join


class Frame:
    """Stands for a DataFrame: keeps the functions that would run in workers."""

    def __init__(self):
        self.runs = []

    def __getattr__(self, name):
        return lambda *args: self

    def mapInArrow(self, run, schema):
        self.runs.append(run)
        return self

    @property
    def sparkSession(self):
        return self

    @property
    def conf(self):
        return self


def batches(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])


def test_a_worker_packs_few_tokens_at_once():
    frame = Frame()
    parity_join.shared_tokens(frame, 100, 3)
    texts = [" ".join(f"w{k}x{n}" for n in range(5000)) for k in range(400)]  # 1.2 million counted tokens
    given = batches(texts)
    tracemalloc.start()
    count = sum(len(value) // 4 for batch in frame.runs[0](given) for bucket, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if bucket >= 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == pytest.approx(0.6 * 400 * 4996, rel=0.01)
    assert peak < 60e6


def test_a_worker_hands_back_its_buffers(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    frame = Frame()
    common.arrow_pass(frame, lambda rows: rows, "text string")
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert sum(batch.num_rows for batch in frame.runs[0](batches(["a", "b"]))) == 2
    assert calls == [1]
