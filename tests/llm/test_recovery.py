"""An executor is killed while an operator runs; the results are those of a run without loss."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

RUN = '''
import os, random, signal, sys, threading, time
from pyspark.sql import SparkSession
from fusewright.llm import jaccard, suffixes

folder = sys.argv[1]
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.checkpoint.dir", folder + "/shared")
         .config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", folder + "/warehouse")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.host", "127.0.0.1").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
rnd = random.Random(5)
pieces = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "%d" % i], k=30)) for i in range(40)]
rows = [(i, " ".join(rnd.choices(pieces, k=rnd.randint(1, 6)))) for i in range(1500)]
docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
docs.write.parquet(folder + "/docs")
docs = spark.read.parquet(folder + "/docs")


def executors():
    out = []
    for p in os.listdir("/proc"):
        try:
            if p.isdigit() and b"CoarseGrainedExecutorBackend" in open("/proc/%s/cmdline" % p, "rb").read() and folder.encode() in open("/proc/%s/environ" % p, "rb").read():
                out.append(int(p))
        except OSError:
            pass
    return out


def both():
    a = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.suffix_dedup(docs).collect()}
    b = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 80).collect()}
    return a, b


calm = both()
lost = []


def strike():
    for wait in (2.0, 6.0, 10.0):
        time.sleep(wait)
        found = executors()
        if found:
            os.kill(found[0], signal.SIGKILL)
            lost.append(found[0])


threading.Thread(target=strike, daemon=True).start()
again = both()
assert lost and calm == again and len(calm[0]) == len(calm[1]) == 1500, (lost, len(again[0]), len(again[1]))
print("same after", len(lost))
'''


def test_a_lost_executor_changes_nothing(tmp_path):
    # Executors' logs go to `work` in Spark's home, so a home of links stands in the test's own folder.
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    (tmp_path / "run.py").write_text(RUN)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYTHONPATH": os.getcwd(), "PYSPARK_PYTHON": sys.executable, "RECOVERY_TEST": str(tmp_path)}
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=400)
    assert "same after" in done.stdout, done.stdout[-500:] + done.stderr[-3000:]
