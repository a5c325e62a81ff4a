"""What Python workers hold while a task runs and after it."""

import ctypes
import re
import weakref
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigloom.llm import bpe, mixing, textkit

DATA = "/root/testdata/sf0.001"


def own_mb():
    return sum(map(int, re.findall(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_the_fit_holds_one_slice_at_a_time(monkeypatch):
    held, most = weakref.WeakSet(), []

    def watched(piece, table=mixing.statistics.table):
        held.add(piece)
        most.append(len(held))
        return table(piece)

    monkeypatch.setattr(mixing.statistics, "table", watched)
    texts = [f"{'good' if i % 2 else 'bad'} words number {i} " * 500 for i in range(200)]
    model = mixing.learn(pa.array(texts), ["clean" if i % 2 else "poor" for i in range(200)], steps=2)
    assert len(model.domains) == 2
    # The next slice is made while the loop still names the last one.
    assert len(most) > 5
    assert max(most) <= 2


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs glibc")
def test_a_task_gives_its_memory_back():
    def run(batches):
        for batch in batches:
            # Every 64th small array stays: what is free lies between them, where free() alone leaves it.
            rows = [np.ones(8_000) for _ in range(4_000)]
            kept.extend(rows[::64])
            del rows
            grown.append(own_mb())
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    for whole in (True, False):
        kept, grown = [], []
        before = own_mb()
        task = textkit.trimmed(run)(iter([batch, batch]))
        assert next(task).equals(batch)
        if whole:
            assert len(list(task)) == 1
        task.close()
        live = sum(x.nbytes for x in kept) / 2**20
        assert grown[0] - before > 150
        assert own_mb() - before < live + 40


def test_a_task_of_another_operator_empties_the_memo():
    encoder = bpe._encoder(b"YQ== 0\nYg== 1\n", ".")
    assert encoder.text("ab").tolist() == [0, 1]
    assert bpe._encoder(b"YQ== 0\nYg== 1\n", ".") is encoder
    list(textkit.trimmed(iter)([]))
    assert not bpe._workers


def test_tasks_of_the_first_stages_give_memory_back(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tasks, real = [], type(docs).mapInArrow

    def noted(self, func, *args, **named):
        tasks.append(func.__qualname__)
        return real(self, func, *args, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    small = docs.where(F.col("doc_id") % 4 == 0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tasks.clear()
        assert stage(spark, small, DATA).columns == docs.columns
        assert tasks, name
        assert all(x.startswith("trimmed") for x in tasks), (name, tasks)


def test_tokens_are_joined_by_the_batch():
    ranks = {b"a": 0, b"bc": 3, b"\xff": 1}
    ids = np.array([0, 3, 1, 3], np.int32)
    assert bpe._joined(bpe._token_table(ranks), ids, [0, 0, 3, 4, 4]).to_pylist() == [b"", b"abc\xff", b"bc", b""]
    assert bpe._joined(bpe._token_table({}), ids[:0], [0, 0]).to_pylist() == [b""]
