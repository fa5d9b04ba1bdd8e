import subprocess
import sys

HOLD = """
import re
import numpy as np
from textloom.llm import arrays as A

pins = []

def run(batches):
    held = [np.ones(100_000, np.uint8) for _ in range(2000)]
    pins.append(held[-1])  # lies above the rest, which the system would get back otherwise
    del held
    yield from batches

def mb():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

before = mb()
assert list(FUNCTION([1, 2])) == [1, 2]
print(mb() - before)
"""


def _held(function):
    return float(subprocess.run([sys.executable, "-c", HOLD.replace("FUNCTION", function)], capture_output=True, text=True, check=True).stdout)


def test_freed_memory_goes_back_at_the_end_of_a_task():
    assert _held("run") > 150
    assert _held("A.released(run)") < 50
