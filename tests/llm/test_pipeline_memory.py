"""What the pipeline's stages leave in their processes, and components that grow by further links."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

from stallwise.llm.graph import components, extended

TRAINING = """
import re, threading, time
import numpy as np
from stallwise.llm import toxicity
from stallwise.llm.memory import give_back

def mb():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

rng = np.random.default_rng(1)
words = np.array(["w%d" % i for i in range(20_000)])
texts = [" ".join(words[rng.integers(0, len(words), 400)]) + " badword" * (i % 3 == 0) for i in range(3_000)]
labels = [int(i % 3 == 0) for i in range(3_000)]
toxicity.fit(texts[:6], labels[:6], steps=1)
give_back()
before, peak, on = mb(), [0], [True]

def watch():
    while on[0]:
        peak[0] = max(peak[0], mb())
        time.sleep(0.005)

seen = threading.Thread(target=watch)
seen.start()
model = toxicity.fit(texts, labels, steps=6)
on[0] = False
seen.join()
give_back()
print(peak[0] - before, mb() - before, model is not None)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux only")
def test_training_is_small_and_gives_its_memory_back():
    """1.2 million tokens: before, marks and weight numbers were held at once and freed memory was kept."""
    root = str(Path(__file__).parents[2])
    out = subprocess.run([sys.executable, "-c", TRAINING], cwd=root, env={"OMP_NUM_THREADS": "1", "PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join([root, *sys.path])}, capture_output=True, text=True, check=True)
    peak, left, fitted = out.stdout.split()
    assert fitted == "True"
    assert float(peak) < 180
    assert float(left) < 40


def test_links_added_later_give_the_same_components(spark):
    rnd = random.Random(4)
    first = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(30)]
    for more in ([], [(a, b) for a, b in first[:5]], [(rnd.randrange(90), rnd.randrange(90)) for _ in range(25)] + [(100, 101)]):
        frame = lambda rows: spark.createDataFrame(rows, "x long, y long")
        one = lambda df: {r["node"]: r["component"] for r in df.collect()}
        got, want = one(extended(components(frame(first)), frame(more))), one(components(frame(first + more)))
        loops = {x for x, y in more if x == y}  # a link to itself joins nothing, and a node of no other link is its own component anyway
        assert {n: c for n, c in got.items() if n not in loops or c != n} == {n: c for n, c in want.items() if n not in loops or c != n}


def test_components_are_left_alone_without_links_between_them(spark):
    """Before, all links were walked again; no result of ``labels`` itself was used."""
    labels = components(spark.createDataFrame([(1, 2), (3, 4), (4, 5)], "x long, y long"))
    assert extended(labels, spark.createDataFrame([(5, 3), (2, 1)], "x long, y long")) is labels
