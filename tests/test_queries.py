"""Some queries against their SQL at the smallest scale; tools/compare.py does all of them."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tesserine.queries import catalog
from tools.compare import rows_of

NAMES = ["prep_min_max_ranges", "prep_percentile_clip_ranges", "prep_train_test_split", "iv_encode_quantile", "iw_forward_arrow", "lib_topk_cosine", "blib_topk_masked_blend", "cls_confusion", "scan_positions", "scan_auroc_events", "box_map", "stream_window_rates"]
NAMES += ["img_pixels_color", "img_rich_edge_color", "img_rich_layout_gray", "img_resize_down", "img_border", "img_patches", "scan_against_masks", "scan_evaluation_split", "src_synthetic_lines", "iw_train_evaluate", "rep_formatted"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    told = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in told.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, told.fetchall())


def test_names():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    told = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not [k for k in q if k.startswith('op') or k == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", told], cwd=tmp_path / "r", check=True, timeout=100)
