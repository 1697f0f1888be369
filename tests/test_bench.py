"""bench.py prints one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_RUNS": "1",
           "BENCH_QUERIES": "pac_frequency", "BENCH_CPUS": "2"}
    out = subprocess.run([sys.executable, os.path.join(REPO, "bench.py")], capture_output=True, text=True,
                         env=env, timeout=600, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["metric"] and rec["value"] > 0
    assert set(rec["queries"]) == {"collect", "pac_frequency"} and rec["sf"] == "0.001"
