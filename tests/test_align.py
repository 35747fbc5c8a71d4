"""Alignment of text lines: what is worked out once per form."""

from __future__ import annotations

from certloom.operators import align
from certloom.plans.align import SCHEMA

TOKENS = [
    "2.11", "1.32", "13.40", "z1.3", "A1", "02", "C02", "CO2", "HE147226", "A200441033", "43.4", "12mm", "1.2.3", "34/56", "金码12",
    "G工", "341", "３４１", "12345", "12345kg", "１2345", "99-88", "+12345", "K1234", "l0O55", "√", "V",
]


def test_tokens_of_one_form_are_judged_once(monkeypatch):
    judged, earns = [], align._Taker.earns
    monkeypatch.setattr(align._Taker, "earns", lambda self, token: judged.append(token) or earns(self, token))
    lines = [f"2.11 341 Ar GZ A{200441000 + n} 22.5 15.0 43.4".split() for n in range(3000)]
    assert align._Aligner(SCHEMA).places(lines) == [list(range(8))] * 3000
    assert len(judged) <= 8 * 8


def test_stand_ins_earn_the_same():
    aligner = align._Aligner(SCHEMA)
    assert aligner._stand_in("A200441033") == "A000000000"
    for token in TOKENS:
        assert [t.earns(token) for t in aligner.takers] == [t.earns(aligner._stand_in(token)) for t in aligner.takers], token


def test_lines_of_any_length_in_one_batch():
    lines = ["", "x " * 300 + "2.11 Ar", "2.11 WL HE147226 22.5 15.0 46.6"]
    aligner = align._Aligner(SCHEMA)
    assert [aligner.values([line]) for line in lines] == [aligner.values(lines)[n * 8:n * 8 + 8] for n in range(3)]
    assert aligner.values(lines)[16:] == ["2.11", "", "", "WL", "HE147226", "22.5", "15.0", "46.6"]
