import os

import pytest
from helpers import token

from maskloom import MaskConfig
from maskloom.plans.jobs import batch_target, mask_log_batch, mask_log_dir, mask_log_file, mask_logs
from maskloom.sinks.output_names import plan_output_names
from maskloom.sources import log_files as src
from maskloom.streaming.log_stream import mask_log_stream

CFG = MaskConfig.default("")
MAIL = token("EMAIL", "a@b.de")


def write(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return path


def visible(folder):
    return sorted(n for n in os.listdir(str(folder)) if not n.startswith("."))


def read(path):
    """The text of a file, or of the parts of a folder in their order."""
    if os.path.isdir(path):
        return "".join(read(os.path.join(path, p)) for p in sorted(os.listdir(path)) if p.startswith("part-"))
    with open(path, encoding="utf-8") as f:
        return f.read()


def test_file(spark, tmp_path):
    log = write(tmp_path, "app.log", "﻿l1 a@b.de\r\nl2\rl3\n\nl5")
    out = str(tmp_path / "out" / "app.log")
    result = mask_log_file(spark, log, out, CFG)
    assert read(out) == f"l1 {MAIL}\nl2\nl3\n\nl5\n"
    assert (result.n_files, result.n_lines, result.n_changed) == (1, 5, 1)
    assert visible(tmp_path / "out") == ["app.log"]
    with pytest.raises(FileExistsError):
        mask_log_file(spark, log, out, CFG)
    with pytest.raises(FileExistsError):
        mask_log_file(spark, log, log.replace("app.log", "APP.log"), CFG)
    write(tmp_path, "app.log", "now c@d.de")
    mask_log_file(spark, log, out, MaskConfig.default("", overwrite=True))
    assert read(out) == f"now {token('EMAIL', 'c@d.de')}\n"


def test_in_place(spark, tmp_path):
    log = write(tmp_path, "app.log", "x a@b.de\n")
    mask_log_file(spark, log, log, MaskConfig.default("", overwrite=True))
    assert read(log) == f"x {MAIL}\n" and os.listdir(tmp_path) == ["app.log"]


def test_empty_and_missing(spark, tmp_path):
    out = str(tmp_path / "out.log")
    mask_log_file(spark, write(tmp_path, "empty.log", ""), out, CFG)
    assert os.path.isdir(out) and read(out) == ""
    with pytest.raises(FileNotFoundError):
        mask_logs(spark, str(tmp_path / "none.log"), out, CFG)
    (tmp_path / "nothing").mkdir()
    result = mask_logs(spark, str(tmp_path / "nothing"), str(tmp_path / "to"), CFG)
    assert result.n_files == 0 and visible(tmp_path / "to") == []


def test_large_file_keeps_its_order(spark, tmp_path):
    n = 60_000
    log = write(tmp_path, "big.log", "".join(f"{i} mail a@b.de\n" for i in range(n)))
    write(tmp_path, "small.log", "a@b.de\n" * 3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        result = mask_log_dir(spark, str(tmp_path), str(tmp_path / "out"), CFG)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert result.n_lines == n + 3 and os.path.getsize(log) > 5 * 100_000
    parts = sorted(p for p in os.listdir(tmp_path / "out" / "big.log") if p.startswith("part-"))
    assert len(parts) > 5
    lines = read(tmp_path / "out" / "big.log").splitlines()
    assert lines == [f"{i} mail {MAIL}" for i in range(n)]
    assert read(tmp_path / "out" / "small.log") == f"{MAIL}\n" * 3


def test_directory(spark, tmp_path):
    for name in ("test1.log", "TEST2.TXT", "ignore.exe", "readme.md", "app_sanitized.log",
                 "old_sanitized_1.log", "a b+c%20é.log", "k=v/inner.log", "sub/inner.log"):
        write(tmp_path / "in", name, f"{name} a@b.de\n")
    write(tmp_path / "in", "none.log", "")
    mask_log_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"), CFG)
    assert visible(tmp_path / "out") == ["TEST2.TXT", "a b+c%20é.log", "none.log", "old_sanitized_1.log", "test1.log"]
    for name in ("TEST2.TXT", "a b+c%20é.log"):
        assert read(tmp_path / "out" / name) == f"{name} {MAIL}\n"
    assert visible(tmp_path) == ["in", "out"]


def test_directory_avoids_taken_names(spark, tmp_path):
    write(tmp_path / "in", "app.log", "a@b.de\n")
    for name in ("app.log", "app_sanitized.log"):
        write(tmp_path / "out", name, "old\n")
    mask_log_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"), CFG)
    assert visible(tmp_path / "out") == ["app.log", "app_sanitized.log", "app_sanitized_1.log"]
    assert read(tmp_path / "out" / "app_sanitized_1.log") == f"{MAIL}\n"
    mask_log_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"),
                 MaskConfig.default("", overwrite=True))
    assert read(tmp_path / "out" / "app.log") == f"{MAIL}\n"


def test_directory_without_a_target(spark, tmp_path):
    write(tmp_path / "in", "app.log", "a@b.de\n")
    mask_log_dir(spark, str(tmp_path / "in"), None, CFG)
    assert read(tmp_path / "in_sanitized" / "app.log") == f"{MAIL}\n"


def test_output_names(spark):
    def plan(names, existing, **how):
        table = plan_output_names(spark.createDataFrame([(n,) for n in names], "name string"),
                                  spark.createDataFrame([(n,) for n in existing], "name string"), **how)
        return {r["name"]: r["output_name"] for r in table.collect()}

    names = ["a.log", "b.log", "b_sanitized.log", "c", "d.e.txt", "x_sanitized.txt", "x.txt"]
    existing = ["a.log", "a_sanitized.log", "a_sanitized_1.log", "a_sanitized_3.log",
                "a_sanitized_01.log", "b.log", "c", "d.e.txt", "d_sanitized.txt", "x.txt"]
    assert plan(names, existing) == {
        "a.log": "a_sanitized_2.log", "b.log": "b_sanitized_1.log",
        "b_sanitized.log": "b_sanitized.log", "c": "c_sanitized", "d.e.txt": "d.e_sanitized.txt",
        "x_sanitized.txt": "x_sanitized.txt", "x.txt": "x_sanitized_1.txt"}
    assert plan(["a.log"], existing, overwrite=True) == {"a.log": "a.log"}


def test_tree_and_listing(spark, tmp_path):
    for name in ("one.log", "deep/two.JSON", "deep/er/three.trace", "deep/no.bin", "single.bin"):
        write(tmp_path, name, "x\n")
    root = str(tmp_path)
    paths = [root, f"{root}/deep", f"{root}/one.log", f"{root}/single.bin", f"{root}/single.bin",
             f"{root}/gone.log"]
    expected = ["one.log", "single.bin", "three.trace", "two.JSON"]
    for make in (src.list_log_tree, src.read_log_tree):
        rows = make(spark, paths).select("source_file").collect()
        assert sorted(r["source_file"] for r in rows) == expected
    twice = spark.createDataFrame([("p",), ("p",), ("q",)], "path string")
    assert src.distinct_paths(twice).count() == 2


def test_invalid_bytes_become_replacement_characters(spark, tmp_path):
    log = write(tmp_path, "raw.log", b"x \xff a@b.de\n")
    assert src.read_log_lines(spark, log).first()["value"] == "x � a@b.de"


def test_batch(spark, tmp_path):
    write(tmp_path, "in/a.log", "a@b.de\n")
    write(tmp_path, "in/sub/b.csv", "a@b.de,1\n")
    write(tmp_path, "in/sub/é %41.xml", "a@b.de\n")
    write(tmp_path, "in/c.txt", "c\n")
    write(tmp_path, "in/c_sanitized.txt", "old\n")
    result = mask_log_batch(spark, [str(tmp_path / "in" / "a.log"), str(tmp_path / "in" / "sub"),
                                    str(tmp_path / "in" / "c.txt")], None, CFG)
    assert (result.n_files, result.n_lines) == (3, 3)
    assert [name for name, _ in result.failures] == ["c.txt"]
    assert "1 failed" in result.summary()
    assert read(tmp_path / "in" / "a_sanitized.log") == f"{MAIL}\n"
    assert read(tmp_path / "in" / "sub" / "b_sanitized.csv") == f"{MAIL},1\n"
    assert read(tmp_path / "in" / "sub" / "é %41_sanitized.xml") == f"{MAIL}\n"
    assert read(tmp_path / "in" / "c_sanitized.txt") == "old\n"
    both = mask_log_batch(spark, [str(tmp_path / "in" / "a.log")], str(tmp_path / "o"), CFG)
    assert both.n_files == 1 and visible(tmp_path / "o") == ["a_sanitized.log"]


@pytest.mark.parametrize("path, target_dir, overwrite, expected", [
    ("/x/a.log", None, False, "/x/a_sanitized.log"), ("/x/a", "/y/", False, "/y/a_sanitized"), ("/x/a.log", "/y", True, "/y/a.log"),
    ("/x/a.", None, False, "/x/a_sanitized"), ("/x.y/a.b\nc.txt", None, False, "/x.y/a.b\nc_sanitized.txt"),
    ("/x/.log", None, False, "/x/_sanitized.log")])
def test_batch_names(apply, path, target_dir, overwrite, expected):
    assert apply([path], lambda p: batch_target(p, target_dir, overwrite)) == [expected]


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    logs, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    write(logs, "one.log", 'a@b.de\n{"k": "10.0.0.1"}\n')
    write(logs, "skip_sanitized.log", "a@b.de\n")

    def run():
        mask_log_stream(spark, str(logs), out, CFG, checkpoint=state, max_files=1).awaitTermination()

    run()
    write(logs, "two.log", "later a@b.de\n")
    run()
    rows = spark.read.text(out).select("source_file", "value").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("one.log", MAIL), ("one.log", f'{{"k":"{token("IP4", "10.0.0.1")}"}}'),
        ("two.log", f"later {MAIL}")]


def test_stream_checkpoint_comes_from_the_session():
    from types import SimpleNamespace

    from maskloom.streaming.log_stream import checkpoint_folder

    def session(**settings):
        conf = {k.replace("_", "."): v for k, v in settings.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key, default)))

    assert checkpoint_folder(session(spark_checkpoint_dir="/shared/state/"), "job") == "/shared/state/job"
    with pytest.raises(ValueError):
        checkpoint_folder(session(), "job")


def test_files_below_a_directory_are_not_opened(spark, tmp_path):
    write(tmp_path, "a.log", "x\n")
    write(tmp_path, "sub/b.log", "y\n")
    os.mkfifo(tmp_path / "sub" / "c.log")  # opening it would never end
    assert [r["value"] for r in src.read_log_dir(spark, str(tmp_path), CFG).collect()] == ["x"]
    assert [r["source_file"] for r in src.list_log_dir(spark, str(tmp_path), CFG).collect()] == ["a.log"]
