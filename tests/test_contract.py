"""Event arrays, job, status, timing, texts and instants on edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from runpulse import functions as fn
from runpulse.operators.audit import contract_audit
from runpulse.operators.grid import run_summaries
from util import NOW, log_of, run_row, run_table, uid, utc


def evaluate(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_job_name(spark):
    argv = lambda *a: json.dumps([{"note": {"argv": list(a)}}])
    cases = {
        argv("/node", "/index.js", "CT_A"): "CT_A",
        argv("/node", "/index.js"): "(default)",
        argv("/node", "/index.js", ""): "(default)",
        argv("/node", "/index.js", "  "): "(default)",
        argv("/node", "/index.js", " \t X \n"): "X",
        argv("/node", "/index.js", 0): "0",
        argv("/node", "/index.js", None): "(default)",
        argv("/node", "/index.js", "null"): "null",
        '[{"note":{"argv":{"2":"X"}}}]': "(default)",
        '[{"note":{}}]': "(default)",
        '[{"note":"text"}]': "(default)",
        "[{}]": "(default)",
        "[]": "(default)",
        "[1]": "(default)",
        "{}": "(default)",
        None: "(default)",
    }
    assert evaluate(spark, list(cases), fn.job_name) == list(cases.values())


STATUS_CASES = {
    '[{"type":"WARN"},{"type":"ERROR"}]': ("ERROR", 2),
    '[{"type":"WARN"}]': ("WARN", 1),
    "[]": ("SUCCESS", 0),
    None: ("SUCCESS", 0),
    '"text"': ("SUCCESS", 0),
    "5": ("SUCCESS", 0),
    "null": ("SUCCESS", 0),
    '[1,{"type":"ERROR"},null]': ("ERROR", 3),
    '[null,{"type":"WARN"}]': ("WARN", 2),
    '{"type":"ERROR"}': ("SUCCESS", 0),
    ' \n[{"type":"ERROR"}]': ("ERROR", 1),
    "{bad": ("SUCCESS", 0),
    "[{'type':'ERROR'}]": ("SUCCESS", 0),
    '[{"a":1},{bad]': ("SUCCESS", 0),
    '[["ERROR"],"ERROR",{"type":["ERROR"]}]': ("SUCCESS", 3),
    '[{"note":{"type":"ERROR"},"type":"INFO"}]': ("SUCCESS", 1),
    '[{"type":"\\u0045RROR"}]': ("ERROR", 1),
    '[7,{"type":"INFO","type":"ERROR"}]': ("ERROR", 2),
}


def test_status_and_issue_count(spark):
    texts = list(STATUS_CASES)
    assert evaluate(spark, texts, fn.derive_status) == [s for s, _ in STATUS_CASES.values()]
    assert evaluate(spark, texts, fn.issue_count) == [n for _, n in STATUS_CASES.values()]
    assert evaluate(spark, texts, lambda c: F.size(fn.parse_events(c))) == [n for _, n in STATUS_CASES.values()]


def random_document(rng):
    def value(depth):
        kinds = ["null", "number", "text", "event", "event", "event"] + (["array", "object"] if depth else [])
        kind = rng.choice(kinds)
        if kind == "event":
            event = {"dt": rng.choice(["2026-06-25T10:00:00Z", "bad", None, 5])}
            if rng.random() < 0.8:
                event["type"] = rng.choice(["INFO", "INFO", "WARN", "ERROR", "error", None, 7, ["ERROR"], {"ERROR": 1}])
            if rng.random() < 0.3:
                event["note"] = value(0) if rng.random() < 0.5 else {"type": "ERROR", "argv": ["a", "b", "J"]}
            return event
        return {
            "null": None,
            "number": rng.randrange(9),
            "text": rng.choice(["ERROR", "", "x", "]"]),
            "array": [value(0) for _ in range(rng.randrange(3))] if depth else 0,
            "object": {"k": value(0)} if depth else 0,
        }[kind]

    text = json.dumps([value(1) for _ in range(rng.randrange(6))] if rng.random() < 0.9 else value(1))
    return text[: rng.randrange(len(text) + 1)] if rng.random() < 0.1 else text


def expected_status(text):
    """The contract on plain Python values."""
    try:
        events = json.loads(text)
    except ValueError:
        events = []
    events = events if isinstance(events, list) else []
    types = [e.get("type") for e in events if isinstance(e, dict)]
    status = "ERROR" if "ERROR" in types else "WARN" if "WARN" in types else "SUCCESS"
    return status, len(events)


def test_random_documents(spark):
    rng = random.Random(17)
    texts = [random_document(rng) for _ in range(3000)]
    want = [expected_status(t) for t in texts]
    both = evaluate(spark, texts, lambda c: F.struct(fn.derive_status(c), fn.issue_count(c)))
    wrong = [(t, tuple(g), w) for t, g, w in zip(texts, both, want) if tuple(g) != w]
    assert not wrong, wrong[:3]
    assert len({s for s, _ in want}) == 3


def test_timing(spark):
    logs = [
        log_of("J", "2026-06-25T10:00:08.385Z", "2026-06-25T10:00:18.268Z"),
        log_of("J", "2026-06-25T10:00:08Z"),
        [{"dt": "not-a-date"}, {"dt": "2026-02-30T00:00:00Z"}],
        log_of("J", "2026-06-25T10:00:18Z", "2026-06-25T10:00:08Z"),
        [{}, {}],
        None,
        log_of("J", "2026-06-25T10:00:00.0000Z", "2026-06-25T09:00:00Z", "2026-06-25T10:00:00.0005Z"),
        '["x",{"dt":"2026-06-25T10:00:00Z"}]',
        '[{"dt":"2026-06-25T10:00:00+00:00"},{"dt":20260625}]',
    ]
    rows = [run_row("a", uid(i), NOW, log) for i, log in enumerate(logs)]
    got = run_summaries(run_table(spark, rows)).orderBy("run_id").collect()
    assert [r.duration_ms for r in got] == [9883, 0, None, None, None, None, 1, None, None]
    alone = evaluate(spark, [r[3] for r in rows], fn.run_timing)
    assert [tuple(t) for t in alone] == [(r.started_at, r.ended_at, r.duration_ms) for r in got]
    assert (got[2].started_at, got[2].ended_at) == (None, None)
    assert got[3].started_at and got[3].ended_at
    assert got[7].started_at is None and got[7].ended_at is not None
    assert got[8].started_at is None


def test_summarize_error(spark):
    long = "line one\nline two   with   spaces\n" + "x" * 500
    got = evaluate(spark, [None, " a \t\n b ", long, "x" * 300, "﻿"], fn.summarize_error)
    assert got[0] is None and got[1] == "a b" and got[3] == "x" * 300 and got[4] == ""
    assert got[2].startswith("line one line two with spaces x") and got[2].endswith(" …(truncated)")
    assert len(got[2]) == 300 + len(" …(truncated)")


def test_white_space_set(spark):
    """Every character of the basic plane, against the contract's list."""
    listed = {9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF}
    chars = spark.range(1, 0xFFFF).where("id NOT BETWEEN 55296 AND 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    for made in (fn.squeeze(F.concat(char, F.lit("x"))), fn.trim_text(F.concat(F.lit("x"), char))):
        assert {r.id for r in chars.where(made == "x").collect()} == listed


def test_instants(spark):
    at = [utc("2026-06-25T11:59:59.999999"), None, utc("2026-06-25T12:00:01")]
    assert evaluate(spark, at, lambda c: fn.age_ms(c, NOW), "timestamp") == [1, None, -1000]
    assert evaluate(spark, at, fn.iso_micros, "timestamp")[0] == "2026-06-25T11:59:59.999999Z"
    assert evaluate(spark, at, fn.iso_seconds, "timestamp")[0] == "2026-06-25T11:59:59Z"


def test_instant_shapes(spark):
    day = "2026-06-25T10:00:00"
    cases = {
        f"{day}Z": f"{day}.000000Z",
        f"{day}.1Z": f"{day}.100000Z",
        f"{day}.123456789Z": f"{day}.123456Z",
        f"{day}Z\n": None,
        f" {day}Z": None,
        f"{day}.Z": None,
        f"{day}z": None,
        "2026-13-01T00:00:00Z": None,
    }
    assert evaluate(spark, list(cases), lambda c: fn.iso_micros(fn.safe_ts(c))) == list(cases.values())


def test_labels(spark):
    assert evaluate(spark, [False, None, True], fn.conn_status, "boolean") == ["OFFLINE", "UNKNOWN", "ONLINE"]
    names = ["ERROR", "WARN", "SUCCESS", "INFO", "ODD", None]
    assert evaluate(spark, names, fn.status_rank) == [0, 1, 2, 3, 99, 99]
    assert evaluate(spark, ["", None, " "], fn.blank_to_null) == [None, None, " "]


def test_issue_subset(spark):
    log = [{"type": "INFO"}, {"type": "ERROR", "err_msg": "e"}, {"type": None}, {"type": "WARN"}]
    got = evaluate(spark, [json.dumps(log)], lambda c: fn.issue_subset(fn.event_fields(c))["type"])
    assert got == [["ERROR", "WARN"]]


def test_audit_counts_each_rule(spark):
    good = log_of("J", "2026-06-25T10:00:00Z", "2026-06-25T10:00:01Z")
    rows = [
        run_row("a", uid(1), NOW, good, []),
        run_row("a", "nope", NOW, good, None),
        run_row("a", uid(2), NOW, "{}", "{bad"),
        run_row("a", uid(3), NOW, list(reversed(good)), [{"type": "ERROR"}]),
        run_row("b", uid(4), NOW, None, None),
    ]
    got = {r.app_name: r.asDict() for r in contract_audit(run_table(spark, rows)).collect()}
    assert got["a"] == {
        "app_name": "a", "runs": 4, "bad_run_id": 1, "upper_case_run_id": 0, "bad_first_dt": 1, "bad_last_dt": 1, "log_not_array": 1,
        "issues_not_array": 1, "default_job": 2, "out_of_order": 1, "issues_not_in_log": 1,
    }
    assert got["b"]["log_not_array"] == 1 and got["b"]["issues_not_array"] == 0


EVENT = '{"type":"ERROR","dt":"2026-06-25T10:00:00Z","note":{"a":1,"b":2}}'


@pytest.mark.parametrize(
    ("log", "issues", "extra", "bad_issues"),
    [
        (f"[{EVENT}]", '[{"note":{"b":2,"a":1},"dt":"2026-06-25T10:00:00Z","type":"ERROR"}]', 0, 0),
        (f"[{EVENT}]", f"[{EVENT},{EVENT}]", 1, 0),
        (f"[{EVENT},{EVENT}]", f"[{EVENT},{EVENT}]", 0, 0),
        ("{bad", f"[{EVENT}]", 1, 0),
        (f"[{EVENT}]", f"[{EVENT}] junk", 0, 1),
        (f"[{EVENT}]", "['a',{'type':'ERROR'}]", 0, 1),
        (f"[{EVENT}]", '[{"type":NaN}]', 0, 1),
        (f"[{EVENT}]", "[7]", 1, 0),
    ],
)
def test_issues_against_the_log(spark, log, issues, extra, bad_issues):
    row = contract_audit(run_table(spark, [run_row("a", uid(1).upper().replace("0", "A"), NOW, log, issues)])).head()
    assert (row.issues_not_in_log, row.issues_not_array, row.upper_case_run_id) == (extra, bad_issues, 1)


def test_text_after_the_array_makes_it_none(spark):
    docs = ['[{"type":"ERROR"}] junk', '[{"type":"ERROR"}] [1]', '[{"type":"ERROR"}],[1]', '[{"type":"ERROR"}] \n']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    assert [r[0] for r in df.select(fn.derive_status(F.col("doc"))).collect()] == ["SUCCESS", "SUCCESS", "SUCCESS", "ERROR"]
