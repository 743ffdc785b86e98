"""Small parts of office files are read at once, with the same rows as step by step, a fault behind them too."""

import io

import pytest
from filequarry.plans import contents
from filequarry.sources import office

BODY = "<r>" + "".join(f"<s><t>{k}</t><u><t>in</t></u></s>" for k in range(30)) + "<t>high</t>"


@pytest.mark.parametrize("end", ["</r>", "</s>", ""])
def test_small_parts_equal_steps(monkeypatch, end):
    def texts():
        found = []
        try:
            for e in office._elements(io.BytesIO((BODY + end).encode()), "t", 3):
                found.append(e.text)
        except office.ElementTree.ParseError:
            found.append("fault")
        return found

    at_once = texts()
    monkeypatch.setattr(office, "SMALL_PART", 100)
    assert texts() == at_once and at_once[:30] == [str(k) for k in range(30)]


def test_small_parts_take_no_steps(monkeypatch):
    monkeypatch.setattr(office.ElementTree, "iterparse", None)
    lines = ["a b c", "d & <e"]
    assert office.office_rows.func([contents.word_file(lines), contents.sheet_file(lines)], ["word", "sheet"]).tolist() == [[["a b c"], ["d & <e"]], [["1", "a", "b", "c"], ["2", "d", "&", "<e"]]]
