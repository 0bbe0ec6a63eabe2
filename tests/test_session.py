"""Shared folders and masters."""

import pytest

from stratum import session


class _Conf(dict):
    def get(self, k, default=None):
        return dict.get(self, k, default)


class _Context:
    def getCheckpointDir(self):
        return None


class _Session:
    def __init__(self, **conf):
        self.conf, self.sparkContext = _Conf(conf), _Context()


def test_no_machine_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.scratch_dir(_Session(**{"spark.master": master}))


def test_a_submitted_master_stays(spark):
    assert session.get_session() is not None
    assert session.get_session(app="other", **{"spark.sql.session.timeZone": "UTC"}).sparkContext.master == spark.sparkContext.master
