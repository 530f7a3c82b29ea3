"""Parsing and masking against Python's own pattern engine."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from logweave.functions import rules as R, text as T
from logweave.operators import logs as L

HAND = [
    "", "   ", "aa:bb:cc:dd:ee:ff up", "12:30:45", "10.0.0.1:80", "fe80:0:0:1", "v1.2.3 and 1.2.3.4.5", "#42 x#7",
    "id 123e4567-e89b-12d3-a456-426614174000 done", "0xDEADbeef 0x", "-5 +3 a-5 3.14 x3.14", "a b  c", "12é é12 ٣٤",
    "tab\tand\nnewline", "  lead and trail \t", "1,234 (56) [78] 9%", "a.b.c 1.a 1.", "::1 a:b:c", "2016-09-28 04:30:30, Info", "　wide　",
]


def masked(text):
    for pattern, mask in T.MASKS:
        text = re.sub(pattern, mask, text)
    return re.sub(r"\s+", " ", text).strip()


def column(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t")).alias("r")).collect()]


def test_masks_equal_python_on_hand_made_text(spark):
    assert column(spark, HAND, T.template_content) == [masked(t) for t in HAND]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet="09af:.-#x_+ \té Z", max_size=40), min_size=200, max_size=200))
def test_masks_equal_python_on_random_text(spark, texts):
    assert column(spark, texts, T.template_content) == [masked(t) for t in texts]


SYSLOG = [
    "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure; ERROR here",
    "Jul  1 09:00:55 host com.apple.cts[258]: added 10.1.1.1",
    "Jun 14 15:16:01 combo kernel: no pid", "Jun 14 15:16:01 host a b [7]:  two", "x", "", "Jun 4 1:2:3 h c[1]: x",
    "Jun 14 15:16:01 host multi\nline[5]: text", "Jun 14 15:16:01 host c[5]: trailing\n", "Jun 14 15:16:01 host c[5]: in\nside", "Jün 14 15:16:01 host c[5]: x",
]


def test_syslog_groups_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SYSLOG)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(T.parse_syslog(F.col("t")).alias("p")).collect()]
    for text, parts in zip(SYSLOG, got):
        match = re.match(T.SYSLOG_PATTERN, text.rstrip("\n"))
        if match is None:
            assert parts is None, text
        else:
            want = dict(zip(T.SYSLOG_FIELDS, match.groups()))
            want["component"] = want["component"].strip()
            assert parts.asDict() == want, text


def test_level_and_address(spark):
    texts = ["a warning then ERROR", "nothing", "errors", "added now", "at 10.0.0.1 and fe", "zz"]
    assert column(spark, texts, T.level_token) == ["WARNING", "", "", "", "", ""]
    want = [m.group(0) if (m := re.search(T.ADDRESS_PATTERN, t)) else "" for t in texts]
    assert column(spark, texts, T.address_token) == want


@pytest.mark.parametrize("flag", [False, True])
def test_parse_and_template_edges(spark, flag):
    rows = [
        (1, "Linux.log", "Jun 14 15:16:01 combo sshd[19939]: port 22 closed"),
        (2, None, None),
        (3, "Mac.log:telegraf", "   "),
        (4, "WINDOWS_2k.log", "2016-09-28 04:30:30, Info  CBS    Loaded 5 items"),
        (5, "linux.log", "no syslog 7"),
    ]
    df = spark.createDataFrame(rows, "log_id long, source string, line string")
    out = {r.log_id: r for r in L.parse_and_template(df, parse_windows=flag).collect()}
    assert (out[1].os, out[1].component, out[1].pid, out[1].templated) == ("linux", "sshd", "19939", "sshd[19939]: port <*> closed")
    assert (out[2].os, out[2].templated, out[2].issue_key) == ("unknown", "unknown", "unknown|unknown|nopid")
    assert out[3].templated == "unknown"
    whole = "unknown: " + masked(rows[3][2])
    assert out[4].templated == ("CBS: Loaded <*> items" if flag else whole)
    assert out[5].templated == "unknown: no syslog <*>"


def test_failure_rules_equal_python(spark):
    texts = [
        "", "SMART Error", "smartness", "io error and link down", "PCIe error", "pci error", "mypci error", "xinetd 5 failed to start",
        "service\nfailed to start", "EXT3-fs: INFO: recovery required", "disk failure raid degraded nvme error overheat memtest psu mce",
        "ſmart", "link down", "storvsp", "cbs_e_invalid_package", "café io error", "packet  loss", "rx/tx error!", "read error_x",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r.s for r in df.select(R.failure_signals(F.col("t")).alias("s")).collect()]
    for text, s in zip(texts, got):
        want = [n for n, p in R.FAILURE_RULES if re.search(p, text, re.IGNORECASE)]
        assert s.evidence == want, text
        assert s.label == (want[0] if want else "unknown")
        assert s.score == (min(1.0, 0.2 * len(want)) if want else 0.0)
        assert s.has_signal == bool(want)


def test_needed_words_only_for_plain_alternations():
    assert R.needed_words(r"\b(pci[e]? error|a.*bc d)\b") == [" error", "bc d"]
    assert R.needed_words(r"\b(a\d+)\b") is None
    assert R.needed_words(r"foo") is None
    assert R.needed_words(r"\b(x{0}y)\b") is None
    assert R.needed_words(r"\b(.*)\b") is None


def test_cooldown_texts(spark):
    texts = ["30m", "1h", "30s", "900", "x", "", None, "2H", "-5m", " 7m", "1_0m", "1__0m", "m"]
    assert column(spark, texts, R.parse_cooldown) == [1800, 3600, 30, 90, 900, 900, 900, 7200, -300, 420, 600, 900, 900]


def test_os_names(spark):
    assert column(spark, ["Mac", " osx ", "WIN", "linux", "", None, "BSD"], T.normalize_os) == [
        "macos", "macos", "windows", "linux", "unknown", "unknown", "bsd"]
    assert column(spark, ["my-Linux.LOG", "x/Mac.log:9", "windowsish", None, "app"], T.os_from_source) == [
        "linux", "macos", "windows", "unknown", "unknown"]


def test_render_action(spark):
    df = spark.createDataFrame([("a1", None, 0.5)], "id string, os string, conf double")
    template = F.lit("{{ alert.id }} {{ alert.os }} {{alert.id}} {{ alert.result.summary }} {{ alert.nope }}")
    out = df.select(T.render_action(template, {"id": F.col("id"), "os": F.col("os")}, {"summary": F.lit("s")}).alias("r"))
    assert out.first().r == "a1 None {{alert.id}} s {{ alert.nope }}"


def test_ascii_texts_take_plain_patterns_and_others_the_same_masks(spark):
    """A text of ASCII alone never meets a pattern with (?U), whose classes cost far more; results are those of Python either way."""
    seen = []
    T.by_alphabet(F.col("t"), lambda t, u: seen.append(u) or t)
    assert sorted(seen) == ["", "U"]
    texts = ["a  b\t7 #8 \x0b -3", " 10.0.0.1\r\n12:30:45  x ", "a\u00a0 b \u2003 7 \u0663", "é  #8\t-3 ", "one blank 5 only"]
    assert column(spark, texts, T.template_content) == [masked(t) for t in texts]
    assert column(spark, [" \t a b \x0b\f\r\n", "\u2003 é \u00a0", ""], T.strip) == ["a b", "é", ""]
