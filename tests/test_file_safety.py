"""Names taken as they stand, nothing dropped, nothing lost when a job fails."""

import os

import pytest
from helpers import token

from maskloom import MaskConfig
from maskloom.plans import jobs
from maskloom.plans.jobs import MaskingFailed, mask_log_batch, mask_log_dir, mask_log_file, mask_logs
from maskloom.sinks import log_files as sink
from maskloom.sources import log_files as src, ranges, store
from maskloom.streaming.log_stream import mask_log_stream
from test_files import CFG, MAIL, read, visible, write

ODD_NAMES = ["app[1].log", "app1.log", "{a}.log", "a.log", "x?.log", "xy.log", "*.log", "c\\d.log", "e,f g.log"]
REPLACE = MaskConfig.default("", overwrite=True)


@pytest.fixture
def odd(tmp_path):
    folder = tmp_path / "in [x]{1}"
    for name in ODD_NAMES:
        write(folder, name, f"{name} a@b.de\n")
    return folder


def test_every_job_opens_the_named_file(spark, tmp_path, odd):
    for name in ODD_NAMES:
        out = str(tmp_path / "files" / name)
        assert mask_log_file(spark, str(odd / name), out, CFG).n_lines == 1
        assert read(out) == f"{name} {MAIL}\n"
    result = mask_log_dir(spark, str(odd), str(tmp_path / "dir*"), CFG)
    assert (result.n_files, result.n_lines) == (len(ODD_NAMES), len(ODD_NAMES))
    assert visible(tmp_path / "dir*") == sorted(ODD_NAMES)
    batch = mask_log_batch(spark, [str(odd / name) for name in ODD_NAMES], str(tmp_path / "batch?"), CFG)
    assert (batch.n_files, batch.n_lines, batch.failures) == (len(ODD_NAMES), len(ODD_NAMES), [])
    tree = mask_log_batch(spark, [str(odd)], str(tmp_path / "tree"), CFG)
    assert (tree.n_files, tree.n_lines, tree.failures) == (len(ODD_NAMES), len(ODD_NAMES), [])
    for name in ODD_NAMES:
        assert read(tmp_path / "dir*" / name) == f"{name} {MAIL}\n"
        for where in ("batch?", "tree"):
            assert read(tmp_path / where / name.replace(".log", "_sanitized.log")) == f"{name} {MAIL}\n"
    rows = src.read_log_lines(spark, str(odd / "app[1].log")).collect()
    assert [(r["value"], r["source_file"]) for r in rows] == [("app[1].log a@b.de", "app[1].log")]


def stream(spark, tmp_path, folder, **how):
    mask_log_stream(spark, str(folder), str(tmp_path / "out"), CFG, checkpoint=str(tmp_path / "state"), **how).awaitTermination()
    rows = spark.read.text(str(tmp_path / "out")).select("source_file", "value").collect()
    return sorted((str(r["source_file"]), r["value"]) for r in rows)


def test_a_stream_reads_every_name_once(spark, tmp_path, odd):
    want = [(name, f"{name} {MAIL}") for name in ODD_NAMES if name not in ("app[1].log", "a.log")]
    for name in ("app[1].log", "a.log"):
        os.rename(odd / name, tmp_path / name)
    assert stream(spark, tmp_path, odd) == sorted(want)
    for name in ("app[1].log", "a.log"):  # beside app1.log and {a}.log, which have been read
        os.rename(tmp_path / name, odd / name)
    for name in ("_late.log", ".late.log"):
        write(odd, name, f"{name} a@b.de\n")
    want += [(name, f"{name} {MAIL}") for name in ("app[1].log", "a.log", "_late.log", ".late.log")]
    assert stream(spark, tmp_path, odd) == sorted(want)
    assert stream(spark, tmp_path, odd) == sorted(want)


def test_a_stream_reads_on_where_a_log_has_grown(spark, tmp_path):
    write(tmp_path / "in", "a.log", "one a@b.de\ntwo")
    write(tmp_path / "in", "b.log", "x\n")
    assert stream(spark, tmp_path, tmp_path / "in") == [("a.log", f"one {MAIL}"), ("a.log", "two"), ("b.log", "x")]
    with open(tmp_path / "in" / "a.log", "a") as log:
        log.write(" more\nthree\n")
    write(tmp_path / "in", "b.log", "")
    want = [("a.log", " more"), ("a.log", f"one {MAIL}"), ("a.log", "three"), ("a.log", "two"), ("b.log", "x")]
    assert stream(spark, tmp_path, tmp_path / "in") == want
    write(tmp_path / "in", "b.log", "new b\n")
    assert stream(spark, tmp_path, tmp_path / "in") == [*want[:4], ("b.log", "new b"), ("b.log", "x")]


def test_what_a_stream_has_seen(tmp_path):
    from maskloom.sources.log_source import ArrivingReader

    write(tmp_path / "in", "a.log", "1\n")
    options = {"path": str(tmp_path / "in"), "state": str(tmp_path / "seen"), "extensions": '[".log"]', "max_files": "1"}
    reader = ArrivingReader(options)
    assert reader.latestOffset() == {"n": 1} and reader.latestOffset() == {"n": 1}
    write(tmp_path / "in", "b.log", "2\n")
    write(tmp_path / "in", "c.log", "3\n")
    write(tmp_path / "in", "c_sanitized.log", "3\n")
    # A reader that was lost after it had written its entry: the next one goes on from there.
    assert ArrivingReader(options).latestOffset() == {"n": 2}
    again = ArrivingReader(options)
    assert again.latestOffset() == {"n": 3} and again.latestOffset() == {"n": 3}
    names = [[piece[0].rpartition("/")[2] for p in again.partitions({"n": n}, {"n": n + 1}) for piece in p.value] for n in range(3)]
    assert names == [["a.log"], ["b.log"], ["c.log"]]


def test_logs_as_a_data_source(spark, tmp_path, odd):
    from maskloom.sources.log_source import LogSource

    write(odd, "_big.log", "".join(f"line {i}\r\n" for i in range(5000)))
    spark.dataSource.register(LogSource)
    df = spark.read.format("log_lines").option("extensions", '[".log"]').option("range_bytes", 4096).option("open_bytes", 64).load(str(odd))
    rows = [(r["source_file"], bytes(r["value"]).decode()) for r in df.collect()]
    assert df.rdd.getNumPartitions() > 10
    assert [v for n, v in rows if n == "_big.log"] == [f"line {i}" for i in range(5000)]
    assert sorted(r for r in rows if r[0] != "_big.log") == sorted((n, f"{n} a@b.de") for n in ODD_NAMES)


def test_names_with_a_leading_mark_are_logs_like_others(spark, tmp_path):
    for name in ("_audit.log", ".old.log", "sub/_deep.log", "sub/.git/x.log", "_masked_sanitized.log", "seen.log", ".note",
                 f"_staging-{'0' * 32}/log.log", "_temporary/0/t.log"):
        write(tmp_path / "in", name, "a@b.de\n")
    result = mask_log_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"), CFG)
    assert result.n_files == 3 and sorted(os.listdir(tmp_path / "out")) == [".old.log", "_audit.log", "seen.log"]
    assert mask_log_file(spark, str(tmp_path / "in" / "_audit.log"), str(tmp_path / "x.log"), CFG).n_lines == 1
    assert read(tmp_path / "x.log") == read(tmp_path / "out" / ".old.log") == f"{MAIL}\n"
    assert [r["value"] for r in src.read_log_lines(spark, str(tmp_path / "in" / ".old.log")).collect()] == ["a@b.de"]
    result = mask_log_batch(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "sub" / "_deep.log")], str(tmp_path / "b"), CFG)
    assert (result.n_files, result.n_lines, result.failures) == (6, 6, [])
    assert sorted(os.listdir(tmp_path / "b")) == [".old_sanitized.log", "_audit_sanitized.log", "_deep_sanitized.log",
                                                  "_masked_sanitized_sanitized.log", "seen_sanitized.log", "x_sanitized.log"]


def test_every_folder_is_listed_once(spark, tmp_path, monkeypatch):
    for i in range(3):
        for j in range(3):
            write(tmp_path / "in", f"{i}/{j}/x.log", "x\n")
    write(tmp_path / "in", "0/parts.log/part-00000.txt", "x\n")
    listed, note = store.children, str(tmp_path / "listed")

    def children(url):
        with open(note, "a") as f:
            f.write(url + "\n")
        return listed(url)

    monkeypatch.setattr(store, "children", children)
    files = src.list_log_tree(spark, [str(tmp_path / "in")])
    assert sorted(r["source_file"] for r in files.collect()) == ["parts.log"] + ["x.log"] * 9
    rounds = open(note).read().splitlines()
    below = [url for url in rounds if url.count("/in") and url.rpartition("/in")[2]]
    assert len(below) == len(set(below)) == 13


def test_a_large_log_in_place_twice(spark, tmp_path):
    n = 30_000
    log = write(tmp_path, "big.log", "".join(f"{i} mail a@b.de\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        mask_log_file(spark, log, log, REPLACE)
        assert os.path.isdir(log) and read(log).splitlines() == [f"{i} mail {MAIL}" for i in range(n)]
        assert mask_logs(spark, log, log, REPLACE).n_lines == n
        assert read(log).splitlines() == [f"{i} mail {MAIL}" for i in range(n)]
        assert mask_log_dir(spark, str(tmp_path), str(tmp_path / "out"), CFG).n_lines == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert read(tmp_path / "out" / "big.log").splitlines() == [f"{i} mail {MAIL}" for i in range(n)]
    batch = mask_log_batch(spark, [str(tmp_path)], None, CFG)
    assert (batch.n_files, batch.n_lines, batch.failures) == (2, 2 * n, [])
    assert visible(tmp_path) == ["big.log", "big_sanitized.log", "out"]


def test_part_names_sort_like_their_numbers():
    ours = [sink.part_name(*i) for i in ((0,), (0, 1), (0, 12), (99_999,), (100_000,), (1_234_567, 3))]
    assert ours == sorted(ours)


def test_unreadable_logs_cost_themselves_only(spark, tmp_path, monkeypatch):
    for i in range(200):
        write(tmp_path / "in", f"{i:03}.log", f"{i} a@b.de\n")
    os.remove(tmp_path / "in" / "077.log")
    os.mkfifo(tmp_path / "in" / "077.log")
    opened = ranges.open_at

    def open_at(url, offset):
        if url.endswith(("/011.log", "/012.log")):
            raise OSError("bad disk")
        return opened(url, offset)

    monkeypatch.setattr(ranges, "open_at", open_at)
    jobs_run, stage = [], jobs._mask_and_stage
    monkeypatch.setattr(jobs, "_mask_and_stage", lambda *a: jobs_run.append(1) or stage(*a))
    result = mask_log_batch(spark, [str(tmp_path / "in")], str(tmp_path / "out"), CFG)
    assert result.failures == [("011.log", "bad disk"), ("012.log", "bad disk"), ("077.log", "not a file")]
    assert (result.n_files, result.n_lines) == (197, 197) and len(jobs_run) == 1
    assert len(visible(tmp_path / "out")) == 197 and read(tmp_path / "out" / "123_sanitized.log") == f"123 {MAIL}\n"
    with pytest.raises(Exception, match="bad disk"):
        src.read_log_lines(spark, str(tmp_path / "in" / "011.log")).collect()
    with pytest.raises(MaskingFailed, match="012.log: bad disk"):
        mask_log_dir(spark, str(tmp_path / "in"), str(tmp_path / "dir"), CFG)
    assert len(visible(tmp_path / "dir")) == 197


def test_a_log_that_fails_half_way_is_not_published(spark, tmp_path, monkeypatch):
    write(tmp_path / "in", "a.log", "".join(f"{i}\n" for i in range(50_000)))
    write(tmp_path / "in", "b.log", "b\n")
    opened = ranges.open_at

    def open_at(url, offset):
        if url.endswith("/a.log") and offset > 150_000:
            raise OSError("bad block")
        return opened(url, offset)

    monkeypatch.setattr(ranges, "open_at", open_at)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        result = mask_log_batch(spark, [str(tmp_path / "in")], str(tmp_path / "out"), CFG)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert result.failures == [("a.log", "bad block")] and visible(tmp_path / "out") == ["b_sanitized.log"]


def test_an_error_that_no_log_is_to_blame_for_ends_the_job_at_once(spark, tmp_path, monkeypatch):
    for i in range(20):
        write(tmp_path / "in", f"{i}.log", "a@b.de\n")
    tries = []

    def fails(*a):
        tries.append(1)
        raise OSError("No space left on device")

    monkeypatch.setattr(jobs, "_mask_and_stage", fails)
    with pytest.raises(OSError, match="No space left"):
        mask_log_batch(spark, [str(tmp_path / "in")], str(tmp_path / "out"), CFG)
    assert len(tries) == 1 and not (tmp_path / "out").exists() or visible(tmp_path / "out") == []


# --- Publishing ---------------------------------------------------------------------

def test_a_failing_move_leaves_the_original_and_keeps_the_work(spark, tmp_path, monkeypatch):
    log = write(tmp_path, "app.log", "x a@b.de\n")
    move = store.move

    def fails(source, target):
        if target.endswith("/app.log") and "/_new-" in source:
            raise OSError("no")
        move(source, target)

    monkeypatch.setattr(store, "move", fails)
    with pytest.raises(MaskingFailed, match="app.log: no"):
        mask_log_file(spark, log, log, REPLACE)
    assert read(log) == "x a@b.de\n"
    kept = [name for name in os.listdir(tmp_path) if name.startswith("_")]
    assert any(name.startswith("_staging-") for name in kept) and not any(name.startswith("_old-") for name in kept)


class Stopped(BaseException):
    """Ends a job like a lost driver: nothing after it runs."""


@pytest.mark.parametrize("old", ["file", "parts", None])
def test_a_stop_at_any_step_is_made_good(tmp_path, monkeypatch, old):
    names, done = ("move", "make_folder", "make_empty", "remove"), 0
    for step in range(30):
        folder = tmp_path / str(step)
        for n in (0, 2):
            write(folder, f"_staging-{'a' * 32}/lines/log_key=k/part_no={n}/part-0000{n}-u.c000.txt", f"new {n}\n")
        if old == "file":
            write(folder, "app.log", "old\n")
        elif old:
            write(folder, "app.log/part-0000000000.txt", "old\n")
        calls = []

        def stops(call):
            def counted(*a):
                if len(calls) == step:
                    raise Stopped
                calls.append(1)
                call(*a)

            return counted

        def publish():
            sink.publish("a" * 32, "k", str(folder / f"_staging-{'a' * 32}" / "lines" / "log_key=k"), str(folder / "app.log"), True)

        with monkeypatch.context() as m:
            for name in names:
                m.setattr(store, name, stops(getattr(store, name)))
            try:
                publish()
                done += 1
            except Stopped:
                pass
        if (folder / "app.log").exists():  # nobody sees half of a log
            assert read(folder / "app.log") in (["old\n"] if old else []) + ["new 0\nnew 2\n"]
        publish()
        publish()
        assert read(folder / "app.log") == "new 0\nnew 2\n" and visible(folder) == sorted(["app.log", f"_staging-{'a' * 32}"])
    assert 0 < done < 25


def test_the_next_job_finishes_what_was_stopped_between_two_renames(spark, tmp_path, monkeypatch):
    log = write(tmp_path, "app.log", "x a@b.de\n")
    other = write(tmp_path, "other.log", "y\n")
    publish = sink.publish_all
    monkeypatch.setattr(sink, "publish_all", lambda *a: (_ for _ in ()).throw(Stopped()))
    removed = store.remove
    monkeypatch.setattr(store, "remove", lambda url: None if "/_staging-" in url else removed(url))
    with pytest.raises(Stopped):
        mask_log_file(spark, log, log, REPLACE)
    monkeypatch.setattr(sink, "publish_all", publish)
    monkeypatch.setattr(store, "remove", removed)
    staging, = (name for name in os.listdir(tmp_path) if name.startswith("_staging-"))
    run, key = staging.rpartition("-")[2], os.listdir(tmp_path / staging / "lines")
    key, = (k.partition("=")[2] for k in key if k.startswith("log_key="))
    # As a task leaves it that was lost between the two renames.
    parts = f"{tmp_path}/_new-{run}-{key}"
    sink._gather(f"{tmp_path}/{staging}/lines/log_key={key}", parts)
    store.make_empty(f"{tmp_path}/{staging}/lines/log_key={key}.gathered")
    store.move(log, f"{tmp_path}/_old-{run}-{key}")
    assert not os.path.exists(log)
    mask_log_file(spark, other, str(tmp_path / "other_out.log"), CFG)
    assert read(log) == f"x {MAIL}\n" and visible(tmp_path) == ["app.log", "other.log", "other_out.log"]


def test_staging_without_a_journal_is_left_alone(spark, tmp_path):
    write(tmp_path, f"_staging-{'b' * 32}/lines/log_key=k/part_no=0/part-00000.txt", "x\n")
    log = write(tmp_path, "app.log", "x\n")
    mask_log_file(spark, log, str(tmp_path / "out.log"), CFG)
    assert visible(tmp_path) == [f"_staging-{'b' * 32}", "app.log", "out.log"]


def test_driver_calls_do_not_grow_with_logs_and_parts(spark, tmp_path, monkeypatch):
    driver, note = os.getpid(), str(tmp_path / "calls")

    def counted(call):
        def inner(*a):
            if os.getpid() == driver:
                with open(note, "a") as f:
                    f.write("x")
            return call(*a)

        return inner

    for name in ("move", "make_folder", "make_empty", "remove", "look", "children"):
        monkeypatch.setattr(store, name, counted(getattr(store, name)))
    counts = []
    for n in (2, 40):
        for i in range(n):
            write(tmp_path / f"in{n}", f"{i}.log", "a@b.de\n" * 10)
        before = os.path.getsize(note) if counts else 0
        assert mask_log_dir(spark, str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}"), CFG).n_files == n
        counts.append(os.path.getsize(note) - before)
    assert counts[0] == counts[1] < 30


def test_all_failures_are_raised(spark, tmp_path, monkeypatch):
    for name in ("a.log", "b.log", "c.log"):
        write(tmp_path / "in", name, "x\n")

    def fails(*a):
        raise OSError("full")

    monkeypatch.setattr(sink, "publish", fails)
    with pytest.raises(MaskingFailed) as failed:
        mask_log_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"), CFG)
    assert failed.value.failures == [(f"{n}.log", "full") for n in "abc"]


def test_token_helper_agrees():
    assert token("EMAIL", "a@b.de") == MAIL
