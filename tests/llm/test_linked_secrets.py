import pytest

from senseloom.llm import secrets

KEY = "aB3" + "dEfGh7jKlM" * 3 + "nOpQrS9"


def kinds(text, reach=secrets.REACH):
    return [secrets.KINDS[k] for _, k, _ in secrets.linked_spans(text, secrets.base_spans(text), reach)]


@pytest.mark.parametrize("prefix", ["AKIA", "ASIA", "AROA", "AIDA", "AGPA"])
def test_each_identifier_links_to_a_bare_key(prefix):
    assert len(KEY) == 40
    assert kinds(f"use {prefix}BCDEFGH1234 with {KEY} here") == ["weak_id", "weak_key"]


def test_an_outer_span_is_not_overlooked():
    starts, ends = [0, 10], [30, 100]
    assert secrets._near(starts, ends, 110, 120, 15)
    assert not secrets._near(starts, ends, 130, 140, 15)
    text = "secret=" + "0123456789abcdef" + "Z" * 60 + " AIDABCDEFGH1234"
    assert secrets.base_spans(text)[0][2] > secrets.base_spans(text)[-1][2]
    assert kinds(text, 20) == ["weak_id"]


@pytest.mark.parametrize("text", ["token=ASIAABCDEFGHIJKL", "secret=AKIAABCDEFGH1234", "see https://h.example/?token=ASIAABCDEFGHIJKL"])
def test_no_part_complements_what_it_overlaps(text):
    assert kinds(text) == []
    assert "weak_id" in kinds(text + " and password: abcdefgh1234")


def test_parts_link_over_a_whole_paragraph_only():
    far = "word " * 200
    assert kinds(f"AIDABCDEFGH1234 {far}{KEY}") == ["weak_id", "weak_key"]
    assert kinds(f"AIDABCDEFGH1234 {far}\n\n{KEY}") == []
