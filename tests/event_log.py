"""Shuffle records that the tasks of a test's stages read, from Spark's event log."""
import contextlib
import glob
import json
import uuid
from statistics import median


class Stages(list):
    def __init__(self):
        super().__init__()
        self.scanned = []
        self.written = 0


@contextlib.contextmanager
def tasks_of(spark, **conf):
    """Run a block under ``conf``; the list it yields is filled with, per stage, the
    records that each task read from shuffles; its ``scanned`` has what tasks read from files,
    its ``written`` the bytes written to shuffles."""
    group, before, found = uuid.uuid4().hex, {k: spark.conf.get(k, None) for k in conf}, Stages()
    for k, v in conf.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        yield found
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    folder = spark.conf.get("spark.eventLog.dir").removeprefix("file://")
    path = max(glob.glob(f"{folder}/{spark.sparkContext.applicationId}*"))
    stages, read = set(), {}
    with open(path) as log:
        for line in log:
            if not line.endswith("\n"):
                break                                      # still being written
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart" and e["Properties"].get("spark.jobGroup.id") == group:
                stages |= set(e["Stage IDs"])
            elif e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages and e.get("Task Metrics"):
                n = e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
                read.setdefault(e["Stage ID"], []).append(n)
                found.written += e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                found.scanned.append(e["Task Metrics"]["Input Metrics"]["Records Read"])
    found += [r for r in read.values() if sum(r)]


def most_uneven(stages, rows: int) -> float:
    """The largest share of the median that a task read, over stages of ``rows`` records or more."""
    return max((max(r) / max(1, median(r)) for r in stages if sum(r) >= rows), default=0.0)
