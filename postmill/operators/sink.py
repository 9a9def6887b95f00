"""Writing an archive: a log of numbered markers says whose it is and which of its parts counts.

The archive is a table of files in chunks (rel, chunk, data): a directory of Parquet parts, as one file for each message would
drown a cluster's file system. Beside the parts stands a log. A run claims the next number by a marker that is created only if
absent, writes a part of its own, reads it back and commits with a second marker of its number. The highest commit counts; what
it names is whole, so a run that ends anywhere leaves the archive as it was.

    root/_postmill/00000007.claim     who writes, what for
    root/_postmill/00000007.commit    the part that counts from here on
    root/files-<run>/                 parts

Of two runs at once one commits: the other finds the number taken, a higher claim, or another commit than it compared with, and is
refused. A run removes its part and claim when it is refused or fails, and after a commit the parts and markers that no longer
count; what this library didn't name stays. Creating a file only if absent is atomic on stores such as HDFS; on those where it
isn't, two claims of one number within the same instant may both pass, and the check before the commit decides.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postmill.operators import compare, payloads

MARKERS, TOOL, VERSION = "_postmill", "postmill", 2
MARKER, PART = re.compile(r"([0-9]{8})\.(claim|commit)"), re.compile(r"files-[0-9a-f]{32}")
#: How often an operation of the file system is tried, and seconds before the second try; each next wait is longer by as much.
TRIES, PAUSE = 5, 0.05
#: Errors that another try doesn't mend.
LASTING = ("FileNotFoundException", "FileAlreadyExistsException", "ParentNotDirectoryException", "PathIsNotEmptyDirectoryException", "AccessControlException")


class Refused(Exception):
    """The export may not go on; the label says why and nothing of any content."""


def kind(error: Py4JJavaError) -> str:
    return error.java_exception.getClass().getSimpleName()


def tried(attempt: Callable, tries: int = TRIES, pause: Callable[[float], None] = time.sleep):
    """What attempt gives; errors of the store that may pass are tried again, a bounded number of times."""
    for n in range(1, tries + 1):
        try:
            return attempt()
        except Py4JJavaError as e:
            if n == tries or kind(e) in LASTING:
                raise
            pause(n * PAUSE)


class Store:
    """The file system below a root, as far as an archive needs it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self.path("/".join([self.root, *names]))

    def names(self, *names: str) -> list[str] | None:
        """Names directly below a folder, hidden ones too; None where nothing stands. A file, and whatever can't be read, raises."""
        try:
            status = tried(lambda: self.files.getFileStatus(self.at(*names)))
        except Py4JJavaError as e:
            if kind(e) == "FileNotFoundException":
                return None
            raise
        if not status.isDirectory():
            raise NotADirectoryError("the target is a file")
        return [s.getPath().getName() for s in tried(lambda: self.files.listStatus(self.at(*names)))]

    def create(self, text: str, *names: str) -> bool:
        """Write a small file only if there is none; False where there is one."""
        try:
            out = tried(lambda: self.files.create(self.at(*names), False))
        except Py4JJavaError as e:
            if "exist" in (e.java_exception.getMessage() or "") or kind(e) == "FileAlreadyExistsException":
                return False
            raise
        try:
            out.write(text.encode())
        finally:
            out.close()
        return True

    def text(self, *names: str) -> str:
        stream = tried(lambda: self.files.open(self.at(*names)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self, *names: str) -> None:
        tried(lambda: self.files.delete(self.at(*names), True))


def log(store: Store) -> dict[tuple[int, str], dict]:
    """The markers of an archive by number and kind; those that are cut off or nobody's are left out."""
    out = {}
    for name in store.names(MARKERS) or []:
        if m := MARKER.fullmatch(name):
            try:
                found = json.loads(store.text(MARKERS, name))
            except ValueError:
                found = None
            if isinstance(found, dict) and found.get("tool") == TOOL:
                out[int(m[1]), m[2]] = found
    return out


def taken(store: Store) -> int:
    """The highest number of a marker, whole or not."""
    return max((int(m[1]) for m in map(MARKER.fullmatch, store.names(MARKERS) or []) if m), default=0)


def current(markers: dict[tuple[int, str], dict]) -> tuple[int, dict] | None:
    """The commit that counts."""
    commits = [n for n, k in markers if k == "commit"]
    return (max(commits), markers[max(commits), "commit"]) if commits else None


def state(spark: SparkSession, root: str, source: str) -> str:
    """absent, empty, owned (complete or not), other_source or not_owned: what a target is before anything is written. What can't be
    read isn't owned."""
    try:
        store = Store(spark, root)
        names = store.names()
        markers = log(store) if names else {}
    except Exception:
        return "not_owned"
    if not names:
        return "absent" if names is None else "empty"
    if not markers:
        return "not_owned"
    return "owned" if markers[max(markers)].get("source") == source else "other_source"


def manifest_of(files: DataFrame) -> DataFrame:
    """(rel, size, sha256) of files (rel, content)."""
    return files.select("rel", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """The files of a complete archive in chunks (rel, chunk, data), None where there is none."""
    found = current(log(Store(spark, root)))
    return spark.read.parquet(f"{root}/{found[1]['part']}") if found else None


def clean(store: Store, number: int, part: str) -> None:
    """Remove the parts and the markers that a commit made useless: those of lower numbers; those of later claims stay."""
    claims = {m.get("part") for (n, _), m in log(store).items() if n > number}
    for name in store.names() or []:
        if PART.fullmatch(name) and name != part and name not in claims:
            store.remove(name)
    for name in store.names(MARKERS) or []:
        if (m := MARKER.fullmatch(name)) and int(m[1]) < number:
            store.remove(MARKERS, name)


def export(files: DataFrame, root: str, source: str, consent: bool = False, over_budget: bool = False, on: Callable[[str], None] = lambda step: None) -> dict:
    """Write files as the archive of source at root: (rel, content), or (rel, chunk, data) for those of any size. Returns the
    preflight's counts, the tree's hash, and the bytes and chunks that were written.

    Raises Refused for a target of somebody else, of another source, one that would change without consent, a plan over budget, two
    files of one path, or a run beside this one. The files are computed once. Where they equal what the archive holds, the log stays
    as it was. `on` is told each step, for tests."""
    spark = files.sparkSession
    found = state(spark, root, source)
    if found in compare.REFUSALS:
        raise Refused(compare.REFUSALS[found])
    if over_budget:
        raise Refused("refused_plan_over_budget")
    store = Store(spark, root)
    base = current(log(store))
    number, part = taken(store) + 1, f"files-{uuid.uuid4().hex}"
    head = {"tool": TOOL, "version": VERSION, "source": source, "part": part}
    if not store.create(json.dumps(head), MARKERS, f"{number:08}.claim"):
        raise Refused("refused_other_run")
    on("claimed")
    done = False
    try:
        cut = files if "chunk" in files.columns else payloads.chunks(files, "content", "rel")
        seen = Observation()  # counted by the tasks that write, so that it costs no second pass
        measured = cut.select("rel", "chunk", "data").observe(seen, F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"), F.count("*").alias("chunks"))
        measured.write.parquet(f"{root}/{part}")
        on("written")
        written = spark.read.parquet(f"{root}/{part}")
        sizes = payloads.digests(written, "rel")
        if not sizes.where("not read").isEmpty():
            raise Refused("refused_path_repeated")
        planned = sizes.select("rel", "size", "sha256")
        before = payloads.digests(spark.read.parquet(f"{root}/{base[1]['part']}"), "rel").select("rel", "size", "sha256") if base else planned.limit(0)
        counts = compare.decision(compare.preflight(planned, before.withColumn("is_file", F.lit(True))), consent, found).first().asDict()
        if counts["decision"] != "go":
            raise Refused(counts["decision"])
        tree = compare.tree_hash(planned).first().asDict() | seen.get
        if base and not counts["create"] + counts["replace"] + counts["unknown"]:
            return counts | {"written": False, **tree}
        on("checked")
        if taken(store) > number or current(log(store)) != base:
            raise Refused("refused_other_run")
        done = store.create(json.dumps(head | {"status": "complete", **tree}), MARKERS, f"{number:08}.commit")
        if not done:
            raise Refused("refused_other_run")
    except Refused:
        raise
    except Exception as e:
        if taken(store) > number:  # a later run has committed and removed what this one wrote
            raise Refused("refused_other_run") from e
        raise
    finally:
        if not done:
            store.remove(part)
            store.remove(MARKERS, f"{number:08}.claim")
            if not base and not store.names(MARKERS):
                store.remove(MARKERS)
    on("committed")
    clean(store, number, part)
    return counts | {"written": True, **tree}
