"""Where scratch tables go: on a cluster whose `spark.checkpoint.dir` has no scheme, as spark-defaults
gives it, and in a local session that has none."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sieveline import session

FINDINGS = {  # numbers of FINDINGS_r03.md
    "F2": "op2_quality_rules", "F3": "op4_simhash", "F5": "op6_token_shards", "F6": "op7_language",
    "F7": "op9_decontamination", "F8": "op10_katz", "F9": "op11_line_dedup", "F14": "artifact_runs",
    "F15": "average_precision", "F16": "boosted_stump", "F17": "column_profile_narrowed", "F18": "candidate_scores",
    "F19": "correlated_pairs", "F20": "comparison_table", "F21": "deploy_manifest", "F22": "evaluation_grid",
    "F23": "diagnostics", "F24": "explain_forest", "F25": "first_record_of_group", "F26": "explain_model",
    "F27": "gbt_scores", "F28": "harmonize_a_csv", "F29": "harmonize_b_csv", "F30": "importance_in_blocks",
    "F31": "importance_matrix", "F32": "knn_exact", "F33": "importance_of_one", "F34": "knn_exact_blocks",
}


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Reached(Exception):
    pass


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    ids = spark.range(400)
    made = {
        "customer": ["id c_custkey", "concat('c', id) c_name", "int(id % 5) c_nationkey", "double(id * 7 % 900 - 50) c_acctbal", "'BUILDING' c_mktsegment"],
        "orders": [
            "id o_orderkey", "id % 90 o_custkey", "element_at(array('F', 'O', 'P'), int(id % 3) + 1) o_orderstatus",
            "double(id * 131 % 4999 * 100) o_totalprice", "timestamp'1995-01-01' o_orderdate", "'1-URGENT' o_orderpriority",
        ],
        "lineitem": [
            "id % 120 l_orderkey", "id % 70 l_partkey", "id % 30 l_suppkey", "int(id % 7) l_linenumber", "double(id * 13 % 50 + 1) l_quantity",
            "double(id * 977 % 9001 * 10 + 900) l_extendedprice", "id * 3 % 11 / 100D l_discount", "id * 5 % 9 / 100D l_tax",
            "element_at(array('R', 'A', 'N'), int(id % 3) + 1) l_returnflag", "'O' l_linestatus", "timestamp'1995-01-01' l_shipdate",
        ],
        "events": [
            "id event_id", "timestamp'2024-01-01' ts", "id % 40 user_id", "id * 37 % 1000 / 10D value", "concat('{\"k\": ', id % 100, '}') props",
            "element_at(array('purchase', 'error', 'signup', 'view', 'click'), int(id % 5) + 1) event_type",
        ],
        "embeddings": ["id vec_id", "transform(sequence(1, 8), i -> float((id * i * 31 % 97) / 97)) embedding", "int(id % 10) label"],
        "documents": [
            "id doc_id", "concat('The keeper of house ', id, ' counted every lamp twice, and wrote it down.\nNobody read it.') text",
            "element_at(array('en', 'de'), int(id % 2) + 1) lang", "'web' source", "60L n_chars",
        ],
        "labels": ["id doc_id", "int(id % 2) quality", "int(id % 3 = 0) toxic"],
        "benchmark": ["id item_id", "concat('Which keeper of house ', id, ' counted every lamp twice?') text"],
    }
    for name, columns in made.items():
        ids.select(*[F.expr(c) for c in columns]).write.parquet(f"{top}/{name}.parquet")
    return top


@pytest.fixture
def reached(spark, monkeypatch):
    """Runs a query up to its first scratch table and gives the folder that the table would go to."""

    def run(name, tables, configured, master):
        real, get = session.shared_dir, type(spark.conf).get

        def reach(s):
            raise Reached(real(s))

        def told(conf, key, *default):
            return configured if key == "spark.checkpoint.dir" else get(conf, key, *default)

        monkeypatch.setattr(session, "shared_dir", reach)
        monkeypatch.setattr(type(spark.conf), "get", told)
        monkeypatch.setattr(spark.sparkContext, "master", master)
        with pytest.raises(Reached) as got:
            entry.queries()[name](spark, tables)
        return str(got.value)

    return run


@pytest.mark.parametrize("number", FINDINGS)
def test_a_cluster_uses_a_folder_without_a_scheme(reached, tables, number):
    assert reached(FINDINGS[number], tables, "/mnt/share/checkpoints", "spark://host:7077") == "/mnt/share/checkpoints"


@pytest.mark.parametrize("number", FINDINGS)
def test_a_local_session_needs_no_folder(reached, tables, number):
    assert os.path.isdir(reached(FINDINGS[number], tables, None, "local[8]"))


_BARE = """
from pyspark.sql import SparkSession
from sieveline import session
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first, second = session.written(spark.range(5)), session.written(spark.range(3))
print(first.count(), second.count(), session.drop_scratch(spark))
"""


def test_a_session_without_a_folder_writes_and_drops_scratch_tables(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", _BARE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["5", "3", "2"], done.stderr[-2000:]
