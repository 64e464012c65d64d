"""The package as workers get it: from the zip alone, without the repository on their path."""

import glob
import os
import subprocess
import sys

from attrix import session


class _Context:
    def addPyFile(self, path):
        self.path = path


class _Spark:
    def __init__(self):
        self.sparkContext = _Context()


def test_every_module_can_be_imported_from_the_zip(tmp_dir):
    spark = _Spark()
    session.ship_code(spark)
    root = os.path.dirname(session.__file__)
    files = [os.path.relpath(f, os.path.dirname(root)) for f in glob.glob(f"{root}/**/*.py", recursive=True)]
    names = sorted(f.removesuffix(".py").removesuffix("/__init__").replace("/", ".") for f in files)
    assert "attrix.operators.trees" in names and "attrix.operators.extra_trees" in names
    code = "import importlib, sys\nfor n in sys.argv[1:]:\n    assert '.zip' in importlib.import_module(n).__file__, n"
    env = os.environ | {"PYTHONPATH": spark.sparkContext.path}
    done = subprocess.run([sys.executable, "-c", code, *names], cwd=tmp_dir, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
