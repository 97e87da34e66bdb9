"""What the Python workers hold while they work."""

import tracemalloc

import pyarrow as pa
import pytest

from cuelark.llm import queries, tokens


class Task:
    get = staticmethod(lambda: Task)
    partitionId = staticmethod(lambda: 0)


@pytest.fixture
def parts(monkeypatch):
    monkeypatch.setattr(tokens, "TaskContext", Task)
    return tokens.encode_parts(queries.tokenizer_path())


def batch() -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": ["ab cd, " * 160] * 4000})


def test_arrays_of_a_part_do_not_grow_with_its_batches(parts):
    one = batch()
    tokens.table(queries.tokenizer_path())
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in parts(iter([one])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 4000 and peak < 60 << 20, peak >> 20


def test_a_part_gives_back_what_arrow_does_not_use(parts, monkeypatch):
    calls = []
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(1)})
    monkeypatch.setattr(tokens.pa, "default_memory_pool", pool)
    assert sum(b.num_rows for b in parts(iter([batch()]))) == 4000 and calls == [1]
