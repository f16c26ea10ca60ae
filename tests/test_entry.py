import subprocess
import sys

import __spark_entry__


def test_names_and_sql_agree():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 80


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["contig", "n_pairs", "overlap_bases"] and df.count() > 0


def test_works_without_the_training_data_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.queries() and not [k for k in e.queries() if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
