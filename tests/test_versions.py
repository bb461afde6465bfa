"""The store of snapshots: commits that stop at any step, batches that come again, writers side by side, readers of old versions."""

from types import SimpleNamespace

import pytest

from inkmill.sources import documents, versions
from inkmill.sources.versions import Version, VersionedStore
from inkmill.streaming import jobs

SCHEMA = "source string, document string, metadata struct<region_code: string>"


def rows(df):
    return sorted((r.source, r.document, r.metadata.region_code) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "store"), SCHEMA)


def frame(store, *data):
    return store.spark.createDataFrame([(s, d, ("0",)) for s, d in data], SCHEMA)


def test_commits_and_snapshots(store):
    assert store.snapshot().count() == 0 and store.version() == Version(0, {}, ())
    store.commit("w", 0, frame(store, ("a", "1"), ("b", "2"), ("c c", "3")))
    old = store.snapshot()
    store.commit("w", 1, frame(store, ("a", "9")), regions=store.spark.createDataFrame([("b", "13")], "source string, region_code string"))
    store.commit("w", 2, gone=store.spark.createDataFrame([("c c",)], "source string"))
    assert store.commit("w", 2, frame(store, ("z", "again"))).number == 3
    assert rows(store.snapshot()) == [("a", "9", "0"), ("b", "2", "13")]
    assert rows(old) == rows(store.snapshot(1)) == [("a", "1", "0"), ("b", "2", "0"), ("c c", "3", "0")]
    store.commit("w", 3, frame(store, ("b", "new")))  # a region set before doesn't touch later rows
    store.compact()
    assert rows(store.snapshot()) == [("a", "9", "0"), ("b", "new", "0")] and len(store.version().parts) == 1 and rows(old)[0] == ("a", "1", "0")
    assert store.commit("w", 3, frame(store, ("z", "again"))).number == 5
    with pytest.raises(ValueError):
        store.snapshot(99)


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_a_stopped_commit_leaves_the_version_before(store, monkeypatch, step):
    store.commit("w", 0, frame(store, ("a", "1"), ("b", "2")))
    calls = 0

    def stopping(name):
        real = getattr(VersionedStore, name)

        def run(self, *args):
            nonlocal calls
            calls += 1
            if calls == step:
                raise KeyboardInterrupt
            return real(self, *args)

        return run

    for name in ("_write", "_publish"):
        monkeypatch.setattr(VersionedStore, name, stopping(name))
    batch = lambda: store.commit("w", 1, frame(store, ("a", "9")), regions=store.spark.createDataFrame([("b", "13")], "source string, region_code string"))
    with pytest.raises(KeyboardInterrupt):
        batch()
    assert rows(store.snapshot()) == [("a", "1", "0"), ("b", "2", "0")] and store.version().number == 1
    batch()
    assert rows(store.snapshot()) == [("a", "9", "0"), ("b", "2", "13")] and store.version().number == 2
    assert store.orphans().count() == (1 if step > 1 else 0)


def test_two_writers_of_one_version(store, monkeypatch):
    """Both find the same last version; one's manifest counts, the other publishes again on top of it."""
    store.commit("w", 0, frame(store, ("a", "1")))
    base, real = store.version(), VersionedStore.version
    other = VersionedStore(store.spark, store.path, SCHEMA)
    other.commit("x", 0, frame(store, ("b", "2")))
    stale = iter([base])
    monkeypatch.setattr(VersionedStore, "version", lambda self, number=None: next(stale, None) or real(self, number))
    store.commit("w", 1, frame(store, ("c", "3")))
    assert rows(store.snapshot()) == [("a", "1", "0"), ("b", "2", "0"), ("c", "3", "0")]


@pytest.mark.parametrize("first", ["0", "f"])
def test_a_published_version_stays(store, monkeypatch, first):
    """A writer that comes later with the same version doesn't take its place, whatever the names of their files."""
    made = iter([first * 32, ("f" if first == "0" else "0") * 32])
    monkeypatch.setattr(versions.uuid, "uuid4", lambda: SimpleNamespace(hex=next(made)))
    assert store._publish(Version(1, {"x": 0}, ()))
    assert not store._publish(Version(1, {"w": 0}, ()))
    assert store.version() == Version(1, {"x": 0}, ())


def test_ingest_once(spark, store, tmp_path, monkeypatch):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.pdf").write_text("hello")
    chunker = lambda b: b.selectExpr("element_at(split(path, '/'), -1) AS source", "CAST(content AS string) AS document", "named_struct('region_code', '0') AS metadata")
    go = lambda: jobs.ingest_once(documents.landing(spark, str(land)), chunker, store, "s", str(tmp_path / "ck")).awaitTermination(120)
    real = VersionedStore.commit

    def fails_after(self, *args):
        real(self, *args)
        raise RuntimeError("the driver is lost after the commit, before the stream has noted it")

    monkeypatch.setattr(VersionedStore, "commit", fails_after)
    with pytest.raises(Exception, match="lost after the commit"):
        go()
    monkeypatch.setattr(VersionedStore, "commit", real)
    (land / "b.pdf").write_text("more")
    go()
    assert rows(store.snapshot()) == [("a.pdf", "hello", "0"), ("b.pdf", "more", "0")] and store.version().number == 2
