"""Stored tables, batches and the shared folder."""

import os
import threading
from urllib.parse import urlparse

import pytest

from umbra.llm import common as C
from umbra.sources import folders


def there(df):
    return os.path.exists(urlparse(df.stored_at).path)


def test_stored_and_dropped(spark):
    before = C.stored(spark.range(5), "before")
    since = C.made(spark)
    a, b = C.stored(spark.range(10), "a", rows=10), C.stored(spark.range(10), "b", gathered=True)
    other = []
    thread = threading.Thread(target=lambda: other.append(C.stored(spark.range(3), "other", few=True)))
    thread.start()
    thread.join()
    C.dropped(spark, since, b)
    assert there(before) and there(b) and there(other[0]) and not there(a) and b.count() == 10
    C.dropped(spark, since)
    assert not there(b) and there(before)


def test_users_settings_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "777")
        C.ready(spark)
        assert spark.conf.get(name) == "777"
        spark.conf.set(name, "10000")
        C.ready(spark)
        assert spark.conf.get(name) == C.BATCHES[name][1]
    finally:
        spark.conf.set(name, old)


def test_no_silent_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId, master = "app", "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.shared_folder(Session(), "x")
    Context.master, Context.applicationId = "local[2]", "other"
    assert folders.shared_folder(Session(), "x").startswith("file://")
