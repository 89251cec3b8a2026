import numpy as np
import pyarrow as pa
import pytest

from tablesight.llm import secrets, toxicity
from tablesight.llm.batches import slices


class Documents:
    """Stands in for a table: gives the function that its tasks would run."""

    columns, schema = ["doc_id", "text"], None

    def mapInArrow(self, function, schema):
        return function


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_slices_hold_every_row_once():
    texts = ["é" * 4, None, "", "a" * 30, None, "b" * 10, "c", "d" * 9, "e"]
    batch = batch_of(texts)
    got = list(slices(iter([batch, batch.slice(0, 0), batch.slice(3, 4)]), 1, 10))
    assert sum((s.column(1).to_pylist() for s in got), []) == texts + texts[3:7]
    assert [s.num_rows for s in got] == [3, 1, 2, 2, 1, 1, 2, 1]
    assert list(slices(iter([batch.slice(0, 0)]), 1)) == []


@pytest.mark.parametrize("step", ["redact", "reject"])
def test_no_step_holds_the_results_of_a_whole_batch(step):
    clean = toxicity.Model(np.zeros(1 << toxicity.BITS, "float32"), 1.0, 1.0, np.array([]), 0.1)
    run = secrets.redact(Documents()) if step == "redact" else toxicity.reject(Documents(), clean)
    texts = [None, "", *("some words of a text " * 5_000 for _ in range(40))]
    got = list(run(iter([batch_of(texts)])))
    assert sum((b.column(1).to_pylist() for b in got), []) == texts
    assert max(sum(len(t or "") for t in b.column(1).to_pylist()) for b in got) <= 1 << 20
