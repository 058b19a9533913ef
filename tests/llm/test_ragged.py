"""What a Python worker keeps between tasks."""

import gc
import weakref

import pyarrow as pa

from playstat.llm import ragged


class _Memo:
    """Holds itself in a cycle, as a memo with its maker does."""

    def __init__(self):
        self.make = lambda: self


def _batches():
    return [pa.RecordBatch.from_arrays([pa.array(["a b", None, "c"])], ["text"])]


def test_a_worker_keeps_one_operators_memo_between_tasks():
    first = ragged.kept("one", _Memo)
    assert sum(b.num_rows for b in ragged.slices(_batches(), keeps="one")) == 3
    assert ragged.kept("one", _Memo) is first


def test_tasks_of_another_operator_free_the_memo():
    gc.disable()
    try:
        gone = weakref.ref(ragged.kept("one", _Memo))
        assert sum(b.num_rows for b in ragged.slices(_batches())) == 3
        assert gone() is None
        gone = weakref.ref(ragged.kept("one", _Memo))
        other = ragged.kept("two", _Memo)
        assert gone() is None and ragged.kept("two", _Memo) is other
    finally:
        gc.enable()
        ragged.give_back()
    assert not ragged._KEPT


def test_empty_input_frees_too():
    gone = weakref.ref(ragged.kept("one", _Memo))
    assert list(ragged.slices([])) == []
    assert gone() is None
