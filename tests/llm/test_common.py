import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultlens.llm.common import as_strings, slices, words_of

from .helpers import WORD, lowered


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x0c\r\x1c éÉß")), max_size=20), st.integers(0, 5))
def test_words_are_exact_on_whole_arrays_and_on_slices(texts, start):
    whole = pa.array(texts, pa.string())
    for own, part in ((texts, whole), (texts[start:], whole.slice(min(start, len(texts))))):
        flat, counts = words_of(as_strings(part), True)
        expected = [WORD.findall(lowered(t)) for t in own]
        assert counts.tolist() == [len(w) for w in expected]
        assert flat.to_pylist() == [w for e in expected for w in e]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (1, 50, 3, 200, 1, 1)])], ["text"])
    parts = list(slices(batch, "text", 60))
    assert [len(p) for p in parts] == [3, 1, 2]
    assert list(slices(batch.slice(0, 0), "text")) == []
