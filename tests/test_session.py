import os
import subprocess
import sys

import pytest

from cpelink import session as S


def test_scratch_is_released(spark):
    df = S.materialize(spark.range(10).toDF("x"), "kept")
    mark = S.scratch_count(spark)
    gone = S.materialize(df.where("x > 3"), "gone")
    assert gone.count() == 6
    path = S._held(spark)[mark]
    assert os.path.isdir(path)
    assert S.release_scratch(spark, since=mark) == 1 and not os.path.exists(path)
    assert df.count() == 10 and S.scratch_count(spark) == mark
    for name in ("a", "b", "c"):
        last = S.materialize(df, name)
    assert S.release_scratch(spark, since=mark, keep=1) == 2 and last.count() == 10


class _Unset:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_unset_shared_folder_is_an_error_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_dir(_Unset)


def test_local_master_without_the_setting_gets_a_folder(tmp_path):
    """In a process whose Spark reads no defaults."""
    code = ("from cpelink.session import local_session, materialize, release_scratch, shared_dir\n"
            "s = local_session(1)\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
            "assert materialize(s.range(5), 'x').count() == 5 and shared_dir(s) == shared_dir(s)\n"
            "assert release_scratch(s) == 1\n"
            "print('fine')\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    ran = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip().endswith("fine"), ran.stderr[-2000:]
