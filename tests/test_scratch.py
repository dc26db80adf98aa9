"""Tables in the shared folder and their versions."""

import os
import subprocess
import sys
import threading

import pytest

from crawlspark.sources import scratch
from crawlspark.sources.versions import Versions


def test_works_without_a_preset_folder(tmp_path):
    code = "from pyspark.sql import SparkSession\nfrom crawlspark.sources.scratch import durable, shared_dir, scratch\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nassert s.conf.get('spark.checkpoint.dir', None) is None\nwith scratch():\n    t = durable(s.range(5))\n    assert t.count() == 5 and shared_dir(s) == shared_dir(s)\nimport os\nassert os.listdir(shared_dir(s) + '/crawlspark') == []\nprint('fine')"
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    assert "fine" in subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120).stdout


def test_threads_don_t_disturb_each_other(spark):
    before, kept = spark.conf.get(scratch.CLEANUP), []

    def work(i):
        with scratch.scratch():
            a = scratch.durable(spark.range(i))
            with scratch.scratch():
                b = scratch.passed_on(scratch.durable(spark.range(2)))
            assert a.count() == i and b.count() == 2
            kept.append(scratch.keep(scratch.durable(a)))

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(t.count() for t in kept) == [0, 1, 2, 3] and spark.conf.get(scratch.CLEANUP) == before
    scratch.discard(*kept)


def test_one_of_several_writers_commits(spark, tmp_path):
    versions, said = Versions(spark, str(tmp_path / "v")), []

    def commit(i):
        try:
            said.append(versions.commit(f"writer {i}", 0))
        except RuntimeError as e:
            said.append(str(e))

    threads = [threading.Thread(target=commit, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert said.count(1) == 1 and versions.newest() == 1 and versions.text(1).startswith("writer")
    assert versions.commit("next", 1) == 2 and versions.text(2) == "next"
    with pytest.raises(RuntimeError):
        versions.commit("late", 0)
