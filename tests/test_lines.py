"""Lines as a data source: splits, numbers, streams; embedding under bounded concurrency with a cache."""

import random
import threading
import time

import pytest

from lorewell.operators import models
from lorewell.sources import golden, lines


def written(path, data):
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_lines_of_a_file_of_many_splits(spark, tmp_path, split):
    rng = random.Random(split)
    rows = ["".join(rng.choices("ab é\t", k=rng.randrange(0, 12))) for _ in range(40)] + ["x" * 500, "", "last"]
    path = written(tmp_path / "f.txt", "\r\n".join(rows[:20]).encode() + b"\n" + "\n".join(rows[20:]).encode())
    got = lines.numbered(lines.read_lines(spark, path, split)).collect()
    assert [(r.line, r.raw) for r in sorted(got, key=lambda r: r.line)] == list(enumerate(rows, 1))
    assert len({r.split for r in lines.read_lines(spark, path, 64).select("split").distinct().collect()}) > 5


def test_folders_odd_files_and_offsets(spark, tmp_path):
    for name, data in (("a.txt", b"one\ntwo\n"), ("b.txt", b""), ("c.txt", b"\n\nx"), ("_hidden", b"no\n"), (".crc", b"no\n")):
        written(tmp_path / name, data)
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.raw) for r in lines.numbered(lines.read_lines(spark, f"file://{tmp_path}")).collect())
    assert got == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("c.txt", 1, ""), ("c.txt", 2, ""), ("c.txt", 3, "x")]
    assert sorted(r.offset for r in lines.read_lines(spark, f"{tmp_path}/a.txt").collect()) == [0, 4]
    assert lines.read_lines(spark, f"{tmp_path}/b.txt").collect() == []
    with pytest.raises(Exception, match="nowhere"):
        lines.read_lines(spark, f"{tmp_path}/nowhere").collect()


def test_golden_cases_across_splits(spark, tmp_path):
    rows = ["# head", ""] + [f'{{"query": "q{k}", "relevant_doc_ids": ["{k}"]}}' for k in range(30)]
    path = written(tmp_path / "g.jsonl", "\n".join(rows).encode())
    assert sorted(r.id for r in golden.read_golden(spark, path, 50).collect()) == sorted(f"case-{k + 3}" for k in range(30))
    with pytest.raises(ValueError):
        golden.read_golden(spark, written(tmp_path / "none.jsonl", b"# nothing\n"))


def test_a_stream_takes_whole_lines_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        q = lines.stream_lines(spark, str(source), 5).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
        return sorted((r.file.rsplit("/", 1)[1], r.offset, r.raw) for r in spark.read.parquet(out).collect())

    written(source / "a", b"one\ntwo\nthr")
    assert run() == [("a", 0, "one"), ("a", 4, "two")]
    with (source / "a").open("ab") as f:
        f.write(b"ee\nfour")
    written(source / "b", b"x\n")
    assert run() == [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "three"), ("b", 0, "x")]


def test_never_more_calls_at_once_and_order_kept():
    now, most, lock = [0], [0], threading.Lock()

    def call(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.005 * (k % 3))
        with lock:
            now[0] -= 1
        return k

    assert list(models.overlapped(((lambda k=k: call(k)) for k in range(40)), 3)) == list(range(40)) and most[0] <= 3
    with pytest.raises(ValueError):
        list(models.overlapped(iter([lambda: int("x")]), 2))


def counting(path):
    """An embedder that writes down each text; a class of the function's own travels to the workers."""

    class Counting:
        def embed(self, texts):
            with open(path, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return models.HashEmbedder(4).embed(texts)

    return Counting()


def test_each_text_is_embedded_once(spark, tmp_path):
    log = str(tmp_path / "log")
    cache = models.embedding_cache(f"{tmp_path}/cache", 4)
    chunks = spark.createDataFrame([(k, f"t{k % 7}") for k in range(40)], "id long, content string").repartition(5)
    got = {r.id: [round(x, 5) for x in r.embedding] for r in models.embed_once(chunks, counting(log), cache, batch=2).collect()}
    assert got == {k: [round(x, 5) for x in models.HashEmbedder(4).embed([f"t{k % 7}"])[0]] for k in range(40)}
    more = spark.createDataFrame([(1, "t3"), (2, "new"), (3, "new")], "id long, content string")
    assert len(models.embed_once(more, counting(log), cache).collect()) == 3
    told = open(log).read().split()
    assert sorted(told) == sorted([f"t{k}" for k in range(7)] + ["new"])
