"""Sinks, sources on a file system, streams and the command line, in temporary folders."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from postmill.__main__ import main
from postmill.functions import texts
from postmill.operators import archive, export, payloads, sink
from postmill.plans import planner
from postmill.sources import containers
from postmill.streaming import manifest


def files(spark, **content):
    return spark.createDataFrame([(k.replace("__", "/"), v.encode()) for k, v in content.items()], "rel string, content binary")


def test_export_is_repeatable_and_owned(spark, tmp_path):
    root = f"{tmp_path}/out"
    first = sink.export(files(spark, a__b="x", c="y"), root, "s1")
    assert first["written"] and first["create"] == 2
    again = sink.export(files(spark, c="y", a__b="x"), root, "s1")
    assert not again["written"] and again["tree_sha256"] == first["tree_sha256"]
    with pytest.raises(sink.Refused, match="refused_needs_consent"):
        sink.export(files(spark, a__b="z", c="y"), root, "s1")
    changed = sink.export(files(spark, a__b="z", c="y"), root, "s1", consent=True)
    assert changed["replace"] == 1 and {(r.rel, bytes(r.content)) for r in payloads.whole(sink.read(spark, root), "rel").collect()} == {("a/b", b"z"), ("c", b"y")}
    with pytest.raises(sink.Refused, match="refused_target_source_mismatch"):
        sink.export(files(spark, c="y"), root, "s2")


def test_foreign_targets_are_refused(spark, tmp_path):
    (tmp_path / "x.txt").write_text("mine")
    assert sink.state(spark, str(tmp_path), "s") == "not_owned"
    with pytest.raises(sink.Refused, match="refused_target_not_owned"):
        sink.export(files(spark, c="y"), str(tmp_path), "s")
    assert sink.state(spark, f"{tmp_path}/none", "s") == "absent"
    assert sink.state(spark, f"{tmp_path}/x.txt", "s") == "not_owned"


def test_an_empty_folder_is_free_and_a_hidden_file_is_somebodys(spark, tmp_path):
    assert sink.state(spark, str(tmp_path), "s") == "empty"
    (tmp_path / ".hidden").write_text("mine")
    assert sink.state(spark, str(tmp_path), "s") == "not_owned"
    (tmp_path / ".hidden").unlink()
    assert sink.export(files(spark, c="y"), str(tmp_path), "s")["written"]
    with pytest.raises(sink.Refused, match="refused_plan_over_budget"):
        sink.export(files(spark, c="y"), str(tmp_path), "s", over_budget=True)


def test_a_target_that_can_not_be_read_is_left_alone(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/out"
    sink.export(files(spark, c="y"), root, "s")
    (tmp_path / "out" / sink.MARKERS).rename(tmp_path / "marker")
    (tmp_path / "out" / sink.MARKERS).write_text("{}")  # a file where Spark would read a folder
    assert sink.state(spark, root, "s") == "not_owned"
    monkeypatch.setattr(sink, "log", lambda *a: 1 / 0)
    assert sink.state(spark, root, "s") == "not_owned"
    with pytest.raises(sink.Refused, match="refused_target_not_owned"):
        sink.export(files(spark, c="y"), root, "s")


def held(spark, root):
    found = sink.read(spark, root)
    return None if found is None else {r.rel: bytes(r.content).decode() for r in payloads.whole(found, "rel").collect()}


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["claimed", "written", "checked", "committed"])
@pytest.mark.parametrize("older", [False, True])
def test_a_crash_at_any_step_leaves_a_whole_archive(spark, tmp_path, monkeypatch, step, older):
    root = f"{tmp_path}/out"
    if older:
        sink.export(files(spark, c="old"), root, "s")

    def crash(at):
        if at == step:
            monkeypatch.setattr(sink.Store, "remove", lambda *a: None)  # nothing is tidied up
            raise Crash

    with pytest.raises(Crash):
        sink.export(files(spark, c="new"), root, "s", consent=True, on=crash)
    monkeypatch.undo()
    assert held(spark, root) == ({"c": "new"} if step == "committed" else {"c": "old"} if older else None)
    assert sink.state(spark, root, "s") == "owned" and sink.state(spark, root, "t") == "other_source"
    assert sink.export(files(spark, c="next"), root, "s", consent=True)["written"]
    assert held(spark, root) == {"c": "next"}
    names = [x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")]
    assert len(names) == 2 and len([x for x in (tmp_path / "out" / sink.MARKERS).iterdir() if sink.MARKER.fullmatch(x.name)]) == 2


def test_a_marker_cut_off_counts_for_nothing(spark, tmp_path):
    root = f"{tmp_path}/out"
    sink.export(files(spark, c="old"), root, "s")
    (tmp_path / "out" / sink.MARKERS / "00000002.claim").write_text('{"tool": "postm')
    (tmp_path / "out" / sink.MARKERS / "00000002.commit").write_text("")
    assert held(spark, root) == {"c": "old"} and sink.state(spark, root, "s") == "owned"
    assert sink.export(files(spark, c="new"), root, "s", consent=True)["written"] and held(spark, root) == {"c": "new"}


def test_of_two_runs_at_once_one_is_refused(spark, tmp_path):
    root = f"{tmp_path}/out"
    sink.export(files(spark, c="old"), root, "s")
    for step, winner in (("claimed", "second"), ("written", "second"), ("checked", "second")):
        run = lambda at, step=step: sink.export(files(spark, c=f"{step} second"), root, "s", consent=True) if at == step else None
        with pytest.raises(sink.Refused, match="refused_other_run"):
            sink.export(files(spark, c=f"{step} first"), root, "s", consent=True, on=run)
        assert held(spark, root) == {"c": f"{step} {winner}"}
    late = []

    def begin(at):  # the other claims a number before this one commits, and comes to its own commit after it
        if at == "committed":
            return
        late.append(at)

    assert sink.export(files(spark, c="last"), root, "s", consent=True, on=begin)["written"] and late == ["claimed", "written", "checked"]
    store = sink.Store(spark, root)
    assert not store.create("{}", sink.MARKERS, f"{sink.taken(store):08}.claim") and held(spark, root) == {"c": "last"}


def test_a_refused_run_leaves_nothing(spark, tmp_path):
    root = f"{tmp_path}/out"
    twice = files(spark, c="x").union(files(spark, c="y"))
    with pytest.raises(sink.Refused, match="refused_path_repeated"):
        sink.export(twice, root, "s")
    assert sink.state(spark, root, "s") in ("absent", "empty")
    sink.export(files(spark, c="x"), root, "s")
    before = sorted(x.name for x in (tmp_path / "out").rglob("*"))
    with pytest.raises(sink.Refused, match="refused_needs_consent"):
        sink.export(files(spark, c="y"), root, "s")
    assert sorted(x.name for x in (tmp_path / "out").rglob("*")) == before


class Moody:
    """Fails a number of times."""

    def __init__(self, error, n):
        self.error, self.n, self.calls = error, n, 0

    def __call__(self):
        self.calls += 1
        if self.calls <= self.n:
            raise self.error
        return "done"


def test_passing_errors_are_tried_again(spark, tmp_path, monkeypatch):
    try:
        sink.Store(spark, str(tmp_path)).text("none")
    except Exception as e:
        missing = e
    waits = []
    with pytest.raises(type(missing)):
        sink.tried(Moody(missing, 9), pause=waits.append)
    assert waits == []  # what isn't there won't come
    monkeypatch.setattr(sink, "LASTING", ())
    assert sink.tried(Moody(missing, 4), pause=waits.append) == "done" and waits == [sink.PAUSE * k for k in (1, 2, 3, 4)]
    again = Moody(missing, 9)
    with pytest.raises(type(missing)):
        sink.tried(again, pause=waits.append)
    assert again.calls == sink.TRIES


def test_files_of_any_size_go_in_chunks(spark, tmp_path):
    root, data = f"{tmp_path}/out", bytes(range(256)) * 4096
    big = payloads.chunks(spark.createDataFrame([("big", data), ("none", b"")], "rel string, content binary"), "content", "rel", size=1000)
    assert sink.export(big, root, "s")["create"] == 2
    assert {r.rel: bytes(r.content) for r in payloads.whole(sink.read(spark, root), "rel").collect()} == {"big": data, "none": b""}
    assert not sink.export(files(spark, big="", none="").where("false").union(spark.createDataFrame([("big", data), ("none", b"")], "rel string, content binary")), root, "s")["written"]


def test_digests_follow_the_chunks(spark):
    data = bytes(i * 7 % 251 for i in range(300_000))
    rows = spark.createDataFrame([(1, "a", data), (1, "b", b""), (2, "a", b"x" * 100), (3, "a", None), (4, "a", b"0123456789")], "id long, name string, content binary")
    parts = payloads.chunks(rows, "content", "id", "name", size=10)
    assert parts.count() == 30_000 + 1 + 10 + 1
    assert {(r.id, r.name): bytes(r.content) for r in payloads.whole(parts, "id", "name").collect()} == {(1, "a"): data, (1, "b"): b"", (2, "a"): b"x" * 100, (4, "a"): b"0123456789"}
    want = {(1, "a"): data, (1, "b"): b"", (2, "a"): b"x" * 100, (4, "a"): b"0123456789"}
    for batch in (1, 7, 64):
        got = {(r.id, r.name): (r.size, r.sha256, r.read) for r in payloads.digests(parts.repartition(5), "id", "name", batch=batch).collect()}
        assert got == {k: (len(v), hashlib.sha256(v).hexdigest(), True) for k, v in want.items()}
    bad = parts.where("not (id = 1 and name = 'a' and chunk = 29000)").union(parts.where("id = 2 and chunk = 3")).withColumn("data", F.expr("if(id = 4, null, data)"))
    declared = spark.createDataFrame([(1, "a", 300_000), (1, "b", 0), (2, "a", 100), (3, "a", 0), (4, "a", 10), (5, "a", None)], "id long, name string, length long")
    assert {(r.id, r.name): r.outcome for r in payloads.checked(bad, declared, "id", "name").collect()} == {(1, "a"): "data_read_failed", (1, "b"): "hashed", (2, "a"): "data_read_failed", (3, "a"): "data_stream_missing", (4, "a"): "data_read_failed", (5, "a"): "data_stream_missing"}
    lengths = spark.createDataFrame([(1, "a", 299_999), (1, "b", None)], "id long, name string, length long")
    assert {r.name: (r.outcome, r.size) for r in payloads.checked(parts, lengths, "id", "name").collect()} == {"a": ("data_length_mismatch", None), "b": ("hashed", 0)}
    assert payloads.digests(parts.limit(0), "id", "name").count() == 0


def test_a_planned_archive_is_written(spark, tmp_path):
    folders = spark.createDataFrame([(1, None, 0, 0, "Inbox"), (2, 1, 1, 0, "a/b")], "folder_id long, parent_id long, depth int, ord long, name string")
    address = dict.fromkeys(("sender_display_name", "sender_address_type", "sender_email_address", "sender_smtp_address", "represented_display_name", "represented_address_type", "represented_email_address", "represented_smtp_address"))
    messages = spark.createDataFrame(
        [(10, 2, "Hi: all", 5, None, 2, 0), (11, 2, "hi_ all", 3, None, None, None), (12, None, "inner", None, None, 9, 9)],
        "message_id long, folder_id long, subject string, delivery_ft long, submit_ft long, importance int, sensitivity int",
    )
    senders = spark.createDataFrame([(10, *{**address, "sender_display_name": "A `x`", "sender_smtp_address": "a@x"}.values())], "message_id long, " + ", ".join(f"{k} string" for k in address))
    recipients = spark.createDataFrame([(10, 2, 1, "B", "EX", "/o", None), (10, 1, 1, None, None, None, None), (10, 3, 3, None, "smtp", "c@x", None)], "message_id long, ord int, raw_type int, display_name string, address_type string, email_address string, smtp_address string")
    attachments = spark.createDataFrame([(10, 1, "f.txt", None, 1, 3, None), (10, 2, None, None, 5, 1, 12)], "message_id long, ord int, long_name string, short_name string, method int, size long, inner_id long")
    bodies = spark.createDataFrame([(10, None, "text with ``` in it\r\n\n"), (11, "\n*md*\n\n", None)], "message_id long, markdown string, plain_text string")
    plan = planner.plan(folders, messages, attachments)
    documents = archive.message_markdown(messages, senders, recipients, bodies, "left")
    payloads = spark.createDataFrame([(10, 1, bytearray(b"abc"))], "message_id long, position long, content binary")
    files_ = export.archive_files(plan, archive.folder_record(folders, messages), documents, payloads=payloads)
    assert sink.export(files_, f"{tmp_path}/out", "box")["create"] == 6
    got = held(spark, f"{tmp_path}/out")
    assert set(got) == {"Inbox/folder.json", "Inbox/a-b/folder.json", "Inbox/a-b/Hi_ all (02)/message.md", "Inbox/a-b/hi_ all/message.md", "Inbox/a-b/Hi_ all (02)/attachments/f.txt", "Inbox/a-b/Hi_ all (02)/attachments/inner/message.md"}
    assert got["Inbox/a-b/Hi_ all (02)/message.md"] == (
        "# Hi: all\n\n- **From:** `` A `x` <a@x> ``\n- **To:** `(unknown)`, `B`\n- **Bcc:** `c@x`\n- **Date:** 1601-01-01T00:00:00Z\n- **Importance:** high\n\n````text\ntext with ``` in it\n````\n"
    ).replace("`` A `x` <a@x> ``", "``A `x` <a@x>``")
    assert got["Inbox/a-b/hi_ all/message.md"] == "# hi_ all\n\n- **Date:** 1601-01-01T00:00:00Z\n\n*md*\n"
    assert got["Inbox/a-b/Hi_ all (02)/attachments/inner/message.md"] == "# inner\n\n- **Importance:** unknown (9)\n- **Sensitivity:** unknown (9)\n"
    assert not sink.export(files_, f"{tmp_path}/out", "box")["written"]


def test_containers(spark, tmp_path):
    for rel in ("a.msg", "sub/B.MSG", "sub/deep/c.msg", "sub/no.txt"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(rel)
    flat, deep = containers.files(spark, str(tmp_path)), containers.files(spark, str(tmp_path), True)
    assert [r.rel for r in flat.collect()] == ["a.msg"] and sorted(r.rel for r in deep.collect()) == ["a.msg", "sub/B.MSG", "sub/deep/c.msg"]
    kept, counted = containers.within_depth(deep, 2)
    assert kept.count() == 2 and counted.first().too_deep == 1
    got = sorted((r.folder, r.parent, r.depth, r.files) for r in containers.folders_of(deep).collect())
    assert got == [("", None, 0, 1), ("sub", "", 1, 1), ("sub/deep", "sub", 2, 1)]
    assert {r.rel: r.sha256 for r in containers.hashed(spark, str(tmp_path)).collect()}["sub/no.txt"] == hashlib.sha256(b"sub/no.txt").hexdigest()


def test_manifest_follows_a_folder(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for k in range(2):
        (box / f"{k}.msg").write_text(str(k))
        q = manifest.follow(spark, str(box), f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination(120)
    assert {r.sha256 for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {hashlib.sha256(str(k).encode()).hexdigest() for k in range(2)}


def test_command_line(spark, sf_dir, capsys):
    assert main(["inventory", sf_dir]) == 0 and "messages=1500" in capsys.readouterr().out
    assert main(["structure", sf_dir]) == 1
    assert main(["inventory", "/nowhere"]) == 2 and "nowhere" not in capsys.readouterr().err


def test_pretty_json(spark):
    got = spark.createDataFrame([('{"b":1,"a":["é"]}',)], "j string").select(texts.pretty("j").alias("p")).first().p
    assert got == json.dumps({"b": 1, "a": ["é"]}, indent=2, ensure_ascii=False) + "\n"


def test_the_command_line_writes_an_archive(spark, sf_dir, tmp_path, capsys):
    root = f"{tmp_path}/out"
    assert main(["export", sf_dir, "--to", root]) == 0
    told = dict(line.split("=", 1) for line in capsys.readouterr().out.splitlines() if "=" in line)
    assert told["written"] == "True" and int(told["create"]) == int(told["files"]) > 1500 and int(told["bytes"]) > 100_000
    names = {r.rel.rsplit("/", 1)[1] for r in sink.read(spark, root).select("rel").collect()}
    assert {"folder.json", "message.md", "metadata.json", "body.html", "body.txt"} <= names
    assert main(["export", sf_dir, "--to", root]) == 0 and "written=False" in capsys.readouterr().out
    assert main(["export", "/nowhere", "--to", root]) == 2
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "x").write_text("x")
    assert main(["export", sf_dir, "--to", f"{tmp_path}/mine"]) == 1 and "refused=refused_target_not_owned" in capsys.readouterr().err
    for wrong in (["export", sf_dir], ["inventory", sf_dir, "--to", root], ["export", sf_dir, "--consent"]):
        with pytest.raises(SystemExit):
            main(wrong)


def test_the_texts_of_a_message_are_made_once(spark):
    """What stands in a document several times (date, fence) is an expression that is evaluated once a message."""
    m = spark.createDataFrame([(1, "s", 116444736000000000, None, 2, 3)], "message_id long, subject string, submit_ft long, delivery_ft long, importance int, sensitivity int")
    fields = ", ".join(f"{p}_{c} string" for p in ("sender", "represented") for c in archive.FOUR)
    people = spark.createDataFrame([(1, "Ann", "SMTP", "a@b", None, None, None, None, None)], f"message_id long, {fields}")
    to = spark.createDataFrame([(1, 1, 1, "Bo", None, None, None)], "message_id long, ord int, raw_type long, " + ", ".join(f"{c} string" for c in archive.FOUR))
    body = spark.createDataFrame([(1, None, "a ``` b\r\n")], "message_id long, markdown string, plain_text string")
    out = archive.message_markdown(m, people, to, body)
    want = "# s\n\n- **From:** `Ann <a@b>`\n- **To:** `Bo`\n- **Date:** 1970-01-01T00:00:00Z\n- **Importance:** high\n- **Sensitivity:** company confidential\n\n````text\na ``` b\n````\n"
    assert out.first().markdown == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("yyyy-MM-dd") == 1 and "array(" not in plan.split("Join")[0]
