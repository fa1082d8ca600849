"""Unicode forms, some texts of a batch at a time."""

import pyarrow as pa
import pytest

from textmill.functions import unicode as U


@pytest.mark.parametrize("at_once", [1, 2, 64])
def test_compatible_takes_some_texts_at_once(monkeypatch, at_once):
    monkeypatch.setattr(U, "AT_ONCE", at_once)
    text = pa.array(["x", "Ａﬁ", None, "", "①"])
    assert U._compatible(text.slice(1)).to_pylist() == ["Afi", None, "", "1"] and U._compatible(text.slice(5)).to_pylist() == []
    assert U._compatible(pa.array([None, None], pa.string())).type == pa.string()
