"""Recognisers, overlaps, replacement in one pass, and the stage that uses them."""

import json

import pytest

from gristmill.operators import recognise, records
from gristmill.operators.recognise import Finder
from gristmill.plans.pipeline import PipelineConfig, Run, prepare


@pytest.mark.parametrize("text,entity", [
    ("write to Some.One+x@mail.example.org now", "EMAIL_ADDRESS"),
    ("key sk-" + "a1B2" * 12 + " here", "API_KEY"),
    ("pay to DE89 3704 0044 0532 0130 00 please", "IBAN_CODE"),
    ("pay to GB82WEST12345698765432.", "IBAN_CODE"),
    ("card 4111 1111 1111 1111 ok", "CREDIT_CARD"),
    ("ssn 123-45-6789", "US_SSN"),
    ("itin 912-70-1234", "US_ITIN"),
    ("host 192.168.10.254 up", "IP_ADDRESS"),
    ("Passport no. A12345678", "US_PASSPORT"),
    ("his bank account is 12345678", "US_BANK_NUMBER"),
    ("call +1 (555) 010-9999 today", "PHONE_NUMBER"),
])
def test_each_identifier(text, entity):
    assert [s[2] for s in Finder().spans(text)] == [entity]
    new, found = Finder().scrub(text)
    assert f"<{entity}>" in new and found == [entity]
    assert Finder(entities=["NONE"]).scrub(text) == (text, [])


@pytest.mark.parametrize("text", ["card 4111 1111 1111 1112", "pay DE12 3704 0044 0532 0130 07", "666-12-3456 and 000-12-3456 and 123-00-4567", "912-93-1234", "300.1.1.1", "1.2.3", "number 12345678 alone", "900/1800/1900 MHz", "", "nothing at all"])
def test_what_does_not_hold(text):
    kinds = {"CREDIT_CARD", "IBAN_CODE", "US_SSN", "US_ITIN", "IP_ADDRESS", "US_BANK_NUMBER", "US_PASSPORT"}
    assert not kinds & {s[2] for s in Finder().spans(text)}


def test_overlaps():
    """The surer span stays, of equally sure ones the longer; replacements are not looked at again."""
    card = "4111 1111 1111 1111"
    assert [s[2] for s in Finder().spans(f"bank account {card}")] == ["CREDIT_CARD"]  # also a phone number by its pattern
    names = {"PERSON": ["Ann", "Ann Lee", "Lee"], "PLACE": ["Lee Street"]}
    assert [s[:3] for s in Finder(names=names).spans("Ann Lee met Leeann at Lee Street, Ann.")] == [(0, 7, "PERSON"), (22, 32, "PLACE"), (34, 37, "PERSON")]
    assert Finder(names={"PERSON": ["PERSON"]}).scrub("PERSON PERSON")[0] == "<PERSON> <PERSON>"
    assert Finder(names={"X": ["é", "日本"]}).scrub("é, 日本, 日本語")[0] == "<X>, <X>, 日本語"
    own = (recognise.Recogniser("TICKET", r"[A-Z]{3}-\d+", 0.9), *recognise.DEFAULT)
    assert Finder(own).scrub("see ABC-123")[0] == "see <TICKET>"


def test_columns(spark):
    df = spark.createDataFrame([(1, "a@b.org and 123-45-6789"), (2, None), (3, "plain words"), (4, "a@b.org, c@d.org")], "id long, text string")
    found = recognise.with_spans(df, "text")
    assert {r.id: [(s.start, s.end, s.entity) for s in r.spans] for r in found.collect()} == {1: [(0, 7, "EMAIL_ADDRESS"), (12, 23, "US_SSN")], 2: [], 3: [], 4: [(0, 7, "EMAIL_ADDRESS"), (9, 16, "EMAIL_ADDRESS")]}
    assert {tuple(r) for r in recognise.entity_counts(found).collect()} == {("EMAIL_ADDRESS", 3, 2), ("US_SSN", 1, 1)}
    with pytest.raises(ValueError, match="names"):
        Finder(names={"X": ["a"] * (recognise.MOST_NAMES + 1)})


def test_stage(spark):
    rows = [{"text": "Ann, a@b.org"}, {"messages": [{"role": "user", "content": "I am Ann"}, {"role": "assistant", "content": "ok 123-45-6789"}]}, {"text": "plain"}, {"text": ""}]
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "_ord long, value string")
    config = PipelineConfig(classification="off", dedup_method="off", quality_mode="off", pii_engine="spans", names=(("PERSON", ("Ann",)),))
    result = Run(config).run(prepare(records.from_lines(lines, keep=("_ord",))))
    out = {r._ord: r for r in result.rows.collect()}
    assert out[0].text == "<PERSON>, <EMAIL_ADDRESS>" and out[2].text == "plain" and out[3].stage == "validate"
    assert [m.content for m in out[1].messages] == ["I am <PERSON>", "ok <US_SSN>"] and out[1].content.count("<") == 2
    assert result.metrics["stages"]["pii"]["entity_counts"] == {"EMAIL_ADDRESS": 1, "PERSON": 2, "US_SSN": 1} and result.metrics["stages"]["pii"]["redacted_records"] == 2
