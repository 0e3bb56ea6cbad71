"""Embedding calls, models asked side by side, tool calls and Markdown, on literal rows."""

import json
import os
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerloom.functions import markdown
from ledgerloom.operators import embedding, models, tools

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import the tests

# ---------------------------------------------------------------- embeddings


class Counting:
    """Notes how many texts each call has."""

    def __init__(self, log, wrong=False):
        self.log, self.wrong = log, wrong

    def __call__(self, texts, kind):
        with open(self.log, "a") as f:
            f.write(f"{kind} {len(texts)}\n")
        return [[float(len(t)), 1.0] for t in texts][: len(texts) - self.wrong]


def calls(log):
    lines = sorted(x.split() for x in open(log)) if os.path.exists(log) else []
    if lines:
        os.remove(log)
    return [(kind, int(n)) for kind, n in lines]


def test_distinct_texts_are_asked_for_once_in_batches(spark, tmp_path):
    log, cache = str(tmp_path / "log"), str(tmp_path / "cache")
    texts = spark.createDataFrame([(k, f"text {k % 300}" if k % 50 else None) for k in range(900)], "id int, text string").repartition(5)
    out = embedding.embedded(texts, cache, lambda: Counting(log), "m", tasks=1)
    assert sorted(calls(log)) == [("document", 295 - 256), ("document", 128), ("document", 128)]
    assert sorted((r.id, r.vector) for r in out.collect()) == [(k, [float(len(f"text {k % 300}")) if k % 50 else 0.0, 1.0]) for k in range(900)]
    assert embedding.embedded(texts, cache, lambda: Counting(log), "m").count() == 900 and calls(log) == [], "all of it is kept"
    more = texts.union(spark.createDataFrame([(1_000, "new"), (1_001, "new")], "id int, text string"))
    got = embedding.embedded(more, cache, lambda: Counting(log), "m", name="v")
    assert calls(log) == [("document", 1)] and got.where("v is null").count() == 0 and got.columns == ["id", "text", "v"]
    # Another model or kind finds nothing of this one's.
    embedding.embedded(texts.limit(1), cache, lambda: Counting(log), "other")
    embedding.embedded(texts.limit(1), cache, lambda: Counting(log), "m", kind="query")
    assert [k for k, _ in calls(log)] == ["document", "query"]


def test_a_failing_embedder_keeps_nothing(spark, tmp_path):
    log, cache = str(tmp_path / "log"), str(tmp_path / "cache")
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    with pytest.raises(Exception, match="vectors for"):
        embedding.embedded(texts, cache, lambda: Counting(log, wrong=True), "m", tasks=1)
    assert embedding.read_cache(spark, cache).count() == 0
    assert embedding.embedded(texts.where("false"), cache, lambda: Counting(log), "m").collect() == []


# -------------------------------------------------------------------- models


class Slow:
    """Earlier prompts take longer; notes the most that were under way at once."""

    most, now, lock = 0, 0, threading.Lock()

    def __call__(self, prompt):
        cls = type(self)
        with cls.lock:
            cls.now += 1
            cls.most = max(cls.most, cls.now)
        time.sleep(0.002 * (40 - int(prompt) % 40))
        with cls.lock:
            cls.now -= 1
        if int(prompt) % 7 == 0:
            raise ValueError(f"no answer to {prompt}")
        return f"re {prompt}"


def test_replies_keep_order_and_bound():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([str(k) if k != 5 else None for k in range(s, s + 40)])], ["prompt"]) for s in (0, 40)]
    Slow.most = 0
    out = [r for b in models._replies(Slow, 0, 3)(iter(batches)) for r in b.to_pylist()]
    assert Slow.most == 3
    for k, r in enumerate(out):
        want = (None, None) if k == 5 else (None, f"ValueError: no answer to {k}") if k % 7 == 0 else (f"re {k}", None)
        assert (r["reply"], r["error"]) == want


class Judge:
    def __init__(self, log):
        self.log = log

    def __call__(self, prompt):
        source, claim = prompt.split("\n\nCLAIM:\n")
        with open(self.log, "a") as f:
            f.write(f"{claim}\n")
        if "boom" in claim:
            raise RuntimeError("socket closed")
        if "babble" in claim:
            return "I think so"
        if "forged" in claim:
            return json.dumps({"verdict": "Supported ", "evidence": "words that are nowhere"})
        return json.dumps({"verdict": "supported" if claim in source else "unsupported"})


def test_claims_are_judged_in_two_passes(spark, tmp_path):
    log = str(tmp_path / "log")
    passages = spark.createDataFrame([("a", 1, "One", "red apples grow"), ("a", 2, "Two", "blue birds sing"), ("b", 1, "One", "only one passage")], "answer_id string, position int, label string, text string")
    rows = [(1, "a", "red apples", [1]), (2, "a", "blue birds", [1]), (3, "a", "green men", [1]), (4, "a", "green dogs", [1, 2]), (5, "b", "green cats", [1]), (6, "a", "blue birds", [9]), (7, "a", "boom", [1]), (8, "a", "babble", [1]), (9, "a", "forged", [2])]
    got = {r.claim_id: (r.verdict, r.error) for r in models.judge(spark.createDataFrame(rows, "claim_id int, answer_id string, claim string, indices array<int>"), passages, lambda: Judge(log)).collect()}
    verdicts = ["supported", "miscited", "unsupported", "unsupported", "unsupported", "miscited", "unjudged", "unjudged", "unjudged"]
    assert [got[k][0] for k in range(1, 10)] == verdicts and got[7][1] == "RuntimeError: socket closed"
    # A second time: only what was not supported and left a passage uncited.
    asked = sorted(x.strip() for x in open(log))
    assert asked == sorted(["red apples", "blue birds", "green men", "green dogs", "green cats", "boom", "babble", "forged"] + ["blue birds", "green men", "blue birds"])


# --------------------------------------------------------------------- tools


def shout(calls):
    return calls.where("text <> 'lost'").select("call_id", F.upper("text").alias("content"))


def registry():
    return tools.Registry((tools.Tool("shout", shout, {"text": "string", "times": "integer", "rate": "number", "loud": "boolean", "tags": "strings"}, ("text",)),)).register(tools.flag_tool())


@pytest.mark.parametrize(
    "name,arguments,content,error",
    [
        ("shout", '{"text": "a"}', "A", False),
        ("shout", '{"text": "a", "times": 2, "rate": 1, "loud": false, "tags": []}', "A", False),
        ("shout", '{"text": "a", "rate": 1.5, "tags": ["x", "y"], "times": null}', "A", False),
        ("shout", '{"text": "lost"}', "Tool shout failed: no result", True),
        ("shout", "{}", "Invalid arguments for shout: missing argument 'text'", True),
        ("shout", None, "Invalid arguments for shout: missing argument 'text'", True),
        ("shout", '{"text": null}', "Invalid arguments for shout: missing argument 'text'", True),
        ("shout", '["text"]', "Invalid arguments for shout: not an object", True),
        ("shout", '{"text', "Invalid arguments for shout: not an object", True),
        ("shout", '{"text": 1}', "Invalid arguments for shout: argument 'text' is no string", True),
        ("shout", '{"text": "a", "times": 1.5}', "Invalid arguments for shout: argument 'times' is no integer", True),
        ("shout", '{"text": "a", "tags": "x"}', "Invalid arguments for shout: argument 'tags' is no strings", True),
        ("shout", '{"text": "a", "colour": 1}', "Invalid arguments for shout: unexpected argument 'colour'", True),
        ("sing", "{}", "Unknown tool 'sing'. Available: propose_flag_at_risk, shout", True),
        (None, "{}", "Unknown tool ''. Available: propose_flag_at_risk, shout", True),
        ("propose_flag_at_risk", '{"issue_key": "ab-1", "rationale": "r", "evidence_rule_ids": ["overdue"]}', "Proposed flagging AB-1 as at-risk. AWAITING HUMAN APPROVAL — nothing has been written to Jira.", False),
        ("propose_flag_at_risk", '{"issue_key": "ab-1", "rationale": "r", "evidence_rule_ids": []}', "Rejected: a flag proposal requires at least one supporting rule id from get_risk_findings.", True),
    ],
)
def test_every_call_has_a_result(spark, name, arguments, content, error):
    rows = registry().execute(spark.createDataFrame([(1, name, arguments)], "call_id int, name string, arguments string")).collect()
    assert [(r.content, r.is_error) for r in rows] == [(content, error)]
    assert (rows[0].proposal is not None) == content.startswith("Proposed")


def test_registries():
    assert [t.name for t in registry().read_only().tools] == ["shout"] and registry().labels()["propose_flag_at_risk"].startswith("Proposed change")
    schema = next(s for s in registry().schemas() if s["name"] == "shout")["input_schema"]
    assert schema["properties"]["tags"] == {"type": "array", "items": {"type": "string"}} and schema["required"] == ["text"]
    with pytest.raises(ValueError):
        registry().register(tools.flag_tool())
    with pytest.raises(ValueError):
        tools.Tool("x", shout, {"a": "date"})
    with pytest.raises(ValueError):
        tools.Tool("x", shout, {}, ("a",))


# ------------------------------------------------------------------ Markdown

HEAD = lambda level, text: {"kind": "heading", "level": level, "text": text}
PAR = lambda text: {"kind": "paragraph", "text": text}
LIST = lambda ordered, *items: {"kind": "list", "ordered": ordered, "items": list(items)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        (None, []),
        ("\n \t\n", []),
        ("one\ntwo  \n  three", [PAR("one two three")]),
        ("one\n\ntwo", [PAR("one"), PAR("two")]),
        ("prose\n## Head\nmore", [PAR("prose"), HEAD(2, "Head"), PAR("more")]),
        ("#no heading\n####### seven", [PAR("#no heading ####### seven")]),
        ("###### six # x", [HEAD(6, "six # x")]),
        (" # indented", [PAR("# indented")]),
        ("---\n***\n ___ ", [{"kind": "rule"}] * 3),
        ("--\n- - -", [PAR("--"), LIST(False, "- -")]),
        ("- a\n* b\n+ c", [LIST(False, "a", "b", "c")]),
        ("- a\n\n- b\n\n\n- c", [LIST(False, "a", "b"), LIST(False, "c")]),
        ("1. a\n2) b\n- c", [LIST(True, "a", "b"), LIST(False, "c")]),
        ("1. a\n\nafter", [LIST(True, "a"), PAR("after")]),
        ("- a\n  wrapped", [LIST(False, "a"), PAR("wrapped")]),
        ("| a | b |\n|---|:-:|\n| 1 | 2 |\n|3|4|", [{"kind": "table", "head": ["a", "b"], "body": [["1", "2"], ["3", "4"]]}]),
        ("|---|", [{"kind": "table", "head": [], "body": []}]),
        ("| a |\ntext\n||", [{"kind": "table", "head": ["a"], "body": []}, PAR("text"), {"kind": "table", "head": [""], "body": []}]),
        ("a\r\nb\r\n\r\n- c\r\n", [PAR("a b"), LIST(False, "c")]),
        ("-x\n1.x", [PAR("-x 1.x")]),
        (" \ntext ", [PAR("text")]),
        ("- ", [LIST(False, "")]),
    ],
)
def test_blocks(text, want):
    assert list(markdown.blocks(text)) == want


def test_blocks_of_long_texts_come_in_bounded_batches(spark):
    df = spark.createDataFrame([(1, "- a\n\nb\n\n" * 3_000, "x"), (2, None, "y"), (3, "|" * 100_000, "z")], "id int, text string, kept string")
    rows = markdown.markdown_blocks(df, most=100).orderBy("id", "ordinal").collect()
    assert [r.ordinal for r in rows if r.id == 1] == list(range(6_000)) and {r.kept for r in rows} == {"x", "z"}
    began = time.time()
    list(markdown.blocks("|" + " |" * 200_000 + "x"))
    list(markdown.blocks("- " * 300_000))
    assert time.time() - began < 5
