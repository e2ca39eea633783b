"""What a worker process holds between the tasks of two operators."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

HELD = """
import re
import pyarrow as pa
from ledgerlens.llm.common import only_cache, worker_cache

def mb():
    rollup = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", rollup))) / 1024

pa.array(["what Arrow loads once"])
only_cache()
before, cache = mb(), worker_cache()
# batches of long texts, each gone before the next
for _ in range(20):
    batch = pa.array(["a long text " * 300] * 10_000)
cache["kept"] = batch
del batch
only_cache()
print(mb() - before)
"""


def test_a_task_starts_without_the_memory_of_earlier_batches():
    run = subprocess.run([sys.executable, "-c", HELD], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert re.fullmatch(r"-?[0-9.]+", run.stdout.strip()), run.stderr
    assert float(run.stdout) < 10
