"""Disguised addresses whose digits or domains are written plainly."""

from __future__ import annotations

import time

import pytest

from labelforge.llm import pii

FOUND = [
    ("ip 192[.]168[.]1[.]1 end", "ip", "192[.]168[.]1[.]1"),
    ("ip 192 (dot) 168 (dot) 1 (dot) 1 end", "ip", "192 (dot) 168 (dot) 1 (dot) 1"),
    ("ip 192 dot 168 dot 1 dot 1 end", "ip", "192 dot 168 dot 1 dot 1"),
    ("ip 192.168[.]1.1, then", "ip", "192.168[.]1.1"),
    ("line 10 192 dot 168 dot 1 dot 1 end", "ip", "192 dot 168 dot 1 dot 1"),
    ("ip 192 punto 168 punto 1 punto 1 end", "ip", "192 punto 168 punto 1 punto 1"),
    ("ask bob at example.com.", "email", "bob at example.com"),
    ("ask bob dot doe at mail.example.com now", "email", "bob dot doe at mail.example.com"),
    ("ask bob at mail.example dot com now", "email", "bob at mail.example dot com"),
]
CLEAN = [
    "steps 1. 2. 3. 4 and 5 - 6", "version 3 dot 11 of 2024", "visit us at example.com today", "more at www.example.com", "docs at example.com/path", "we met at noon.Then it rained",
    "Error: x\n  at com.example.Main.run(Main.java:3)", "costs 5 at 3.50 each",
]


@pytest.mark.parametrize(("text", "kind", "source"), FOUND)
def test_plain_digits_and_domains(text, kind, source):
    spans = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [(kind, source)]
    assert source not in pii.redact(text, spans) and f"[{kind.upper()}]" in pii.redact(text, spans)


@pytest.mark.parametrize("text", CLEAN)
def test_left_alone(text):
    assert pii.disguised_spans(text, pii.plain_spans(text)) == []


def test_long_white_space_takes_linear_time():
    """A text of blanks, line feeds or brackets of any length; before, 16,000 blanks took 12 seconds."""
    for filler in (" ", "\n", "[", " \t", "[ ", "at ", "5 "):
        for text in (filler * 200_000 + "x bob at example.com", "5" + filler * 200_000 + "bob [at] example [dot] org"):
            began = time.perf_counter()
            found = pii.disguised_spans(text, pii.plain_spans(text))
            assert time.perf_counter() - began < 8, filler
            assert filler in ("at ", "5 ", "[", "[ ") or len(found) == 1


def test_runs_of_white_space_around_disguises():
    for text in ("bob  [ at ]  example  [ dot ]  org", "bob [at] example [dot] mail [dot] org", "bob (at)\n example (dot) org", "x  bob\tat example dot org"):
        assert [k for _, k, _ in pii.disguised_spans(text, pii.plain_spans(text))] == [0], text
