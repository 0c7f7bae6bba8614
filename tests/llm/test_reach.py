"""How far apart parts of a credential may lie."""

import pytest

from opsloom.llm import secrets

BOB, KEY = "client_id = bob7", "Zx8kQ92mmPq0TTyu1"


@pytest.mark.parametrize("gap", [1, 200, 201, 100_000])
def test_the_paragraph_is_the_bound(gap):
    assert [k for *_, k in secrets.scan(BOB + " " * gap + KEY)] == ["identity", "linked"]
    assert [k for *_, k in secrets.scan(BOB + " " * gap + "password: hunter2")] == ["identity", "assign"]
    assert secrets.scan(BOB + "\n" + " " * gap + "\n" + KEY) == []


@pytest.mark.parametrize("gap,links", [(1, True), (200, True), (201, False), (1000, False)])
def test_a_reach_can_be_asked_for(gap, links):
    found = [k for *_, k in secrets.scan(BOB + " " * gap + KEY, 200)]
    assert found == (["identity", "linked"] if links else [])
    assert [k for *_, k in secrets.scan(KEY + " " * gap + BOB, 200)] == (["linked", "identity"] if links else [])


def test_base_findings_need_no_partner():
    assert [k for *_, k in secrets.scan(BOB + "\n\n" + "password: hunter2")] == ["assign"]
