"""Fill-in-middle: units against a plain search, exact round trips, stable draws."""
import hashlib
import re

from hypothesis import given, settings, strategies as st
from oracle import compare, duck

from telltale.llm import infill
from telltale.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXT = st.text(st.sampled_from("ab \t\n\x0b\x0c\ré😀<>PSM\x1c\xa0"), max_size=40)


@given(TEXT, st.integers(-5, 10 ** 12))
@settings(max_examples=400, deadline=None)
def test_units_and_round_trip(text, doc_id):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    w = infill.write(text, doc_id)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    assert w.n == len(units) and infill.restored(w.output, w.form) == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        assert (w.form, w.output, w.prefix, w.middle) == ("plain", text, None, None)
    else:
        low, high = sorted((h[0] % (w.n + 1), h[1] % (w.n + 1)))
        p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        assert (w.prefix, w.middle) == (len(p), len(m)) and w.form == ("spm" if h[3] % 100 < 80 else "psm")
        assert w.output == (f"<S>{s}<P>{p}<M>{m}" if w.form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_every_form_comes_up_and_comes_back():
    forms = set()
    for i in range(400):
        text = f"<{'S' * (i % 3)} word <P{i} <M\n> <S> "[: 3 + i % 20]
        w = infill.write(text, i)
        forms.add(w.form)
        assert infill.restored(w.output, w.form) == text
    assert forms == {"plain", "psm", "spm"}


def test_very_long_text():
    for text in ("a " * 1_000_000, " " * 3_000_000, "x" * 3_000_000):
        for i in range(6):
            w = infill.write(text, i)
            assert infill.restored(w.output, w.form) == text and w.n == (1_000_001 if text[0] == "a" else 1)


def test_query_equals_sql(spark):
    text, ok = compare(spark, duck(SF), SF, *QUERIES["op12_fill_in_middle"])
    assert ok, text


def test_odd_rows(odd_docs, no_docs):
    rows = infill.inverted(infill.transformed(odd_docs)).collect()
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["text"] or "") for r in odd_docs.collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["restored"]) for r in rows) == texts
    assert {(r["n"], r["form"], r["middle_chars"]) for r in rows if r["doc_id"] in (3, 4)} == {(0, "plain", None)}
    assert len({(r["form"], r["output"]) for r in rows if r["doc_id"] is None}) == 1, "repeated rows are written alike"
    assert infill.inverted(infill.transformed(no_docs)).collect() == []
