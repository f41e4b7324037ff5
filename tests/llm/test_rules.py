"""The ledger against a plain count of windows, and policies against the ledger."""
import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from oracle import compare, duck
from telltale.llm import rules
from telltale.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_repeat(words, w=8):
    grams = Counter(tuple(words[i:i + w]) for i in range(len(words) - w + 1))
    return len({i + o for i in range(len(words) - w + 1) if grams[tuple(words[i:i + w])] > 1 for o in range(w)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeated_words_equal_a_plain_count(words):
    found = rules.measure(" ".join(words).encode())
    assert found[rules.MEASURES.index("n_repeat_words")] == slow_repeat(words)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé漢 \t\n\x0b\x1c #|A!", max_size=40))
def test_measures_equal_the_contract(text):
    got = dict(zip(rules.MEASURES, rules.measure(text.encode())))
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
    assert got["n_dup_lines"] == len(lines) - len(set(lines))


def test_query_equals_sql(spark):
    text, ok = compare(spark, duck(SF), SF, *QUERIES["op1_quality_rules"])
    assert ok, text


def test_odd_rows(odd_docs, no_docs):
    rows = rules.ledger(odd_docs).collect()
    assert len(rows) == 16 and rules.ledger(no_docs).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == 0 and by[3].fail_bits & 1 and by[5].n_words == 0
    assert by[9].n_repeat_words == 30000 and by[9].fail_bits & 2


def test_policies_are_masks_of_one_ledger(real_docs):
    book = rules.ledger(real_docs).cache()
    n = book.count()
    for policy in rules.POLICIES:
        kept = book.where(rules.verdict(policy)).count()
        parts = {r.rule: r for r in rules.ablations(book, policy).collect()}
        for i, rule in enumerate(rules.RULES):
            if rule in rules.POLICIES[policy] and rule in parts:
                others = rules.mask(policy) & ~(1 << i)
                assert parts[rule].failed == book.where(f"fail_bits & {1 << i} != 0").count()
                assert parts[rule].kept_without == book.where(f"fail_bits & {others} = 0").count()
                assert parts[rule].kept_without - parts[rule].failed_alone == kept
    spread = rules.failures(book, ["doc_id"]).agg({"docs": "sum"}).first()[0]
    assert spread == n
