"""Raw JSON logs through sources, ledgers and sessions."""

import json
import os

import pytest

from sessionloom.plans.layers import Inputs, Layers
from sessionloom.sources import chat_blobs, jsonl
from sessionloom.sources.counter_logs import counter_records
from sessionloom.sources.response_logs import response_records

REPO = "/work/repo"


def write(path, records):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def meta(at, cwd=REPO, **more):
    return {"timestamp": at, "type": "session_meta", "payload": {"id": "s", "timestamp": at, "cwd": cwd, "model_provider": "openai", **more}}


def context(at, model, cwd=REPO):
    return {"timestamp": at, "type": "turn_context", "payload": {"cwd": cwd, "model": model}}


def event(at, kind, **more):
    return {"timestamp": at, "type": "event_msg", "payload": {"type": kind, **more}}


def tokens(at, total=None, last=None):
    usage = lambda v: None if v is None else dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"), v))
    info = {k: v for k, v in (("total_token_usage", usage(total)), ("last_token_usage", usage(last))) if v}
    return event(at, "token_count", info=info)


def t(second, hour=10):
    return f"2026-08-04T{hour:02d}:00:{second:02d}Z"


@pytest.fixture
def layers(spark, tmp_path):
    def build(counter=None, response=None, chunk_rows=1 << 17):
        repos = spark.createDataFrame([(1, REPO, "sha256:r")], "repo_id bigint, root string, fingerprint string")
        frames = {}
        if counter:
            write(f"{tmp_path}/counter/a.jsonl", counter)
            frames["counter_records"] = counter_records(jsonl.raw_records(jsonl.read_lines(spark, {f"{tmp_path}/counter": "active"})))
        if response:
            for name, records in response.items():
                write(f"{tmp_path}/response/{name}", records)
            raw = jsonl.raw_records(jsonl.read_lines(spark, {f"{tmp_path}/response": "custom"}))
            write(f"{tmp_path}/response/main/subagents/agent-1.meta.json", [{"agentType": "Explore"}])
            sidecars = jsonl.read_documents(spark, f"{tmp_path}/response", "*.meta.json")
            frames["response_records"] = response_records(raw, sidecars)
        return Layers(Inputs(repos, chunk_rows=chunk_rows, **frames))

    return build


@pytest.mark.parametrize("chunk_rows", [2, 1 << 17])
def test_model_switch_duplicate_direct_usage_and_reset(layers, chunk_rows):
    built = layers(
        [
            meta(t(0)), context(t(1), "gpt-5-mini"), tokens(t(2), (100, 20, 10, 4, 110)), tokens(t(3), (100, 20, 10, 4, 110)),
            context(t(4), "gpt-5.6-sol"), tokens(t(5), (240, 40, 30, 12, 270)),
            tokens(t(6), (290, 50, 35, 14, 325), (50, 10, 5, 2, 55)), tokens(t(7), (8, 2, 3, 1, 11)), event(t(5), "task_complete"),
        ],
        chunk_rows=chunk_rows,
    )
    rows = {r["model"]: (r["calls"], r["usage"]["total"]) for r in built.model_usage.collect()}
    assert rows == {"gpt-5-mini": (1, 110), "gpt-5.6-sol": (3, 226)}
    session = built.sessions.collect()[0]
    assert session["usage"]["total"] == 336 and session["status"] == "completed"


def test_an_omitted_field_is_no_reset(layers):
    second = tokens(t(3), (150, 0, 60, 0, 210))
    del second["payload"]["info"]["total_token_usage"]["reasoning_output_tokens"]
    built = layers([meta(t(0)), context(t(1), "gpt-5-mini"), tokens(t(2), (100, 0, 50, 20, 170)), second])
    usage = built.model_usage.collect()[0]["usage"]
    assert (usage["total"], usage["input"], usage["output"]) == (210, 150, 60)


@pytest.mark.parametrize("chunk_rows", [3, 1 << 17])
def test_only_the_segment_inside_the_repository_counts(layers, chunk_rows):
    away = "/work/elsewhere"
    built = layers(
        [
            meta(t(0, 9), away), context(t(1, 9), "gpt-5.6-terra", away), event(t(2, 9), "user_message", message="outside"),
            event(t(3, 9), "agent_message", message="outside"), tokens(t(4, 9), (100, 20, 10, 0, 110)),
            context(t(0), "gpt-5.6-sol"), event(t(1), "user_message", message="inside"), event(t(2), "agent_message", message="inside"),
            {"timestamp": t(3), "type": "response_item", "payload": {"type": "function_call", "name": "apply_patch"}},
            tokens(t(4), (250, 50, 30, 0, 280)), event(t(5), "task_complete"),
            context(t(0, 11), "gpt-5.6-terra", away), event(t(1, 11), "user_message", message="outside"), tokens(t(2, 11), (400, 80, 50, 0, 450)),
        ],
        chunk_rows=chunk_rows,
    )
    session = built.sessions.collect()[0]
    assert (session["turns"], session["assistant_messages"], session["tool_calls"], session["usage"]["total"]) == (1, 1, 1, 170)
    assert session["model_refs"] == ["gpt-5.6-sol"]
    assert str(session["started_at"]) == "2026-08-04 10:00:00" and str(session["ended_at"]) == "2026-08-04 10:00:05"


def assistant(second, model, stop, content, **usage):
    return {"type": "assistant", "sessionId": "c", "cwd": REPO, "timestamp": t(second), "message": {"role": "assistant", "model": model, "stop_reason": stop, "content": content, "usage": usage}}


def user(second, content, mode=None):
    return {"type": "user", "sessionId": "c", "cwd": REPO, "timestamp": t(second), "permissionMode": mode, "message": {"role": "user", "content": content}}


TEXT = {"type": "text", "text": "reply"}


def test_response_log_with_a_child_log(layers):
    main = [
        user(0, "first", "plan"),
        assistant(1, "claude-fixture", "tool_use", [TEXT, {"type": "tool_use", "id": "u", "name": "Read"}], input_tokens=100, output_tokens=20,
                  cache_creation_input_tokens=10, cache_read_input_tokens=5, cache_creation={"ephemeral_1h_input_tokens": 6, "ephemeral_5m_input_tokens": 4}),
        user(2, [{"type": "tool_result", "content": "x"}]),
        user(3, "second", "default"),
        "not json",
        assistant(4, "claude-fixture", "end_turn", [TEXT], input_tokens=50, output_tokens=10, cache_read_input_tokens=8),
    ]
    built = layers(response={"main.jsonl": main, "main/subagents/agent-1.jsonl": [assistant(1, "claude-fixture", "end_turn", [TEXT], input_tokens=25, output_tokens=5)]})
    s = built.sessions.collect()[0]
    assert (s["turns"], s["plan_turns"], s["assistant_messages"], s["tool_calls"], s["subagents"], s["status"]) == (2, 1, 2, 1, 1, "completed")
    assert s["tool_refs"] == ["Agent:Explore", "Read"]
    u = s["usage"]
    assert (u["input"], u["output"], u["cache_write"], u["cache_write_1h"], u["cache_write_5m"], u["cache_read"], u["cached"], u["total"]) == (175, 35, 10, 6, 4, 13, 0, 233)
    cost = built.costs.collect()[0]
    assert (cost["total_micro"], cost["priced_tokens"], cost["unpriced_tokens"]) == (None, 0, 233)


def test_two_models_and_bookkeeping_messages(layers):
    m = 1_000_000
    built = layers(response={"main.jsonl": [
        user(0, "first"), assistant(1, "claude-sonnet-4-5-20250929", "end_turn", [TEXT], input_tokens=m, output_tokens=m),
        assistant(3, "claude-opus-4-1-20250805", "end_turn", [TEXT], input_tokens=2 * m, output_tokens=2 * m),
        assistant(4, "<synthetic>", "stop_sequence", [TEXT], input_tokens=0, output_tokens=0),
    ]})
    rows = {r["model"]: (r["calls"], r["cost_micro"]) for r in built.model_usage.collect()}
    assert rows == {"claude-sonnet-4-5-20250929": (1, 18_000_000), "claude-opus-4-1-20250805": (1, 180_000_000)}
    assert built.sessions.collect()[0]["assistant_messages"] == 2


def test_lines_keep_their_numbers(spark, tmp_path):
    write(f"{tmp_path}/x/a.jsonl", ['{"a": 1}\r', "", "[1]", '{"b": "' + "y" * (4 * 1024 * 1024) + '"}', '{"c": 2}'])
    lines = jsonl.read_lines(spark, {f"{tmp_path}/x": "active"})
    assert [r["ordinal"] for r in jsonl.raw_records(lines).orderBy("ordinal").collect()] == [1, 4, 5]
    limit = 4 * 1024 * 1024
    assert [r["ordinal"] for r in jsonl.raw_records(lines, limit).orderBy("ordinal").collect()] == [1, 5]
    audit = jsonl.scan_audit(lines, limit).collect()[0]
    assert (audit["oversized"], audit["invalid_json"]) == (1, 1)
    assert jsonl.scan_audit(lines).collect()[0]["oversized"] == 0


def test_lines_are_numbered_across_splits(spark, tmp_path):
    wanted = [json.dumps({"n": i, "pad": "x" * (i % 97)}) if i % 5 else "" for i in range(1, 4001)]
    write(f"{tmp_path}/y/a.jsonl", wanted)
    write(f"{tmp_path}/y/b.jsonl", wanted[:3])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        lines = jsonl.read_lines(spark, {f"{tmp_path}/y": "active"})
        assert lines.rdd.getNumPartitions() >= 1
        got = {(r["source_id"][-7:], r["ordinal"]): r["line"] for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.jsonl", i + 1): w for i, w in enumerate(wanted) if w} | {("b.jsonl", i + 1): w for i, w in enumerate(wanted[:3]) if w}


def test_blobs_are_read_whole(spark):
    deep = json.dumps({"role": "user", "text": "deep"})
    for _ in range(20):
        deep = f'{{"x": [{deep}]}}'
    many = json.dumps([{"role": "assistant", "text": str(i)} for i in range(2500)])
    rows = [("w", "cursorDiskKV", "composerData:a", deep), ("w", "cursorDiskKV", "composerData:b", many), ("w", "cursorDiskKV", "composerData:c", "[" * 200_000)]
    blobs = spark.createDataFrame(rows, "workspace string, tbl string, key string, value string")
    got = chat_blobs.blob_messages(blobs).orderBy("pos").collect()
    assert [(r["pos"], r["text"]) for r in got] == [(0, "deep"), *((i + 1, str(i)) for i in range(2500))]
    assert chat_blobs.blob_messages(blobs, max_messages=7, max_depth=8).count() == 7
