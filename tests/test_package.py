"""What is sent to tasks must work where this package is not installed."""

import subprocess
import sys

from pyspark import cloudpickle

from tablesight.operators.html import _parse


def test_task_functions_carry_their_code(tmp_path):
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(_parse))
    code = "import pickle; f = pickle.load(open('f.pkl', 'rb')); print(f('<title>ok</title>')[0])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "ok", done.stderr
