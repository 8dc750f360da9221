"""Problem 3: each kind of defect, good short and quoting answers, coverage against brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import pairs as P

Q = "What is the total of the invoice?"
CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, " ​\n", "empty"), (Q, "n/a", "empty"), (Q, "(no answer)", "empty"), (Q, "—", "empty"),
    (Q, "Invoice amounts to 12.00 EUR including tax and", "truncated"), (Q, "The total of the invo", "truncated"), (Q, "It is (as stated in the annex", "truncated"),
    (Q, "I'm sorry, but I can't help with that request.", "refusal"), ("Wer hat das genehmigt?", "Dazu darf ich keine Auskunft geben.", "refusal"), (Q, "Thank you for your question. I am unable to answer this question. Have a nice day.", "refusal"),
    (Q, "WHAT IS THE TOTAL OF THE INVOICE?", "copied"), (Q, f"You asked: {Q}", "copied"), (Q, f"{Q}\n{Q}", "copied"),
    (Q, "Die Rechnung beläuft sich auf 22.91 EUR einschließlich Steuer und Fracht.", "other_language"), ("Quel est le montant de la franchise ?", "The policyholder bears an excess of 5 EUR per event.", "other_language"),
    (Q, "12.00 EUR", None), (Q, "No", None), (Q, "Main points:\n- label rolls, 12\n- valve sets, 3", None), (Q, f"{Q} It is 12 EUR in total.", None), (Q, "No. The policy does not cover it.", None),
    ("Please answer in German: What is the total?", "Die Rechnung beläuft sich auf 22.91 EUR einschließlich Steuer.", None), (Q, "I cannot find a date on page one, but page two gives it. The total is 12 EUR.", None), (None, "Yes, it is.", None), (None, None, "empty"),
]


@pytest.mark.parametrize("query,answer,want", CASES)
def test_defect(query, answer, want):
    assert P.defect(query, answer) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=8))
def test_match_lengths_equal_brute_force(prompt, answer):
    got = P.SuffixAutomaton(prompt).match_lengths(answer)
    runs = {tuple(prompt[i:j]) for i in range(len(prompt)) for j in range(i + 1, len(prompt) + 1)}
    for i in range(len(answer)):
        assert got[i] == max((n for n in range(1, i + 2) if tuple(answer[i + 1 - n : i + 1]) in runs), default=0)


def test_rows(spark):
    rows = [(i, q, a, "x") for i, (q, a, _) in enumerate(CASES)] * 2 + [(99, Q, "word " * 30000 + "end.", "x")]
    df = spark.createDataFrame(rows, "query_id bigint, query string, answer string, defect string")
    got = {r.query_id: r.defect for r in P.find_defects(df).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(CASES) if w}
    assert P.find_defects(df.where("query_id < 0")).count() == 0


def test_wider_refusals_and_short_answers():
    assert P.defect("What is the risk?", "I must refuse to give legal opinions.") == "refusal"
    assert P.defect("What is the risk?", "Sorry, that is outside what I can do.") == "refusal"
    assert P.defect("What is the risk?", "We would rather not comment on the price.") == "refusal"
    assert P.defect("Can the contract be transferred?", "It cannot be transferred without the consent of the seller.") is None
    assert P.defect("How long is the warranty?", "Twelve months from signature") is None
    assert P.defect("How long is the warranty?", "The warranty of the") == "truncated"


def test_spanish_is_no_french():
    assert P.defect("¿Cuánto dura la garantía de cartuchos de filtro?", "El fabricante concede 25 meses de garantía para cartuchos de filtro desde la recepción.") is None
    assert P.defect("¿Cuánto dura la garantía de cartuchos de filtro?", "Le fabricant accorde 25 mois de garantie sur les cartouches.") == "other_language"
