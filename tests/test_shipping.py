"""Queries that run Python in tasks must work when the working folder is not the repository."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from threadlens.session import local_session
spark = local_session(2, 4)
import __spark_entry__ as E
for name in {names!r}:
    print(name, E.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("names", [["h1_listing_threads", "h4_posts_from_pages", "h8_visible_text", "x1_stream_ingest"]])
def test_from_another_folder(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, names=names)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    for name in names:
        assert any(line.startswith(name + " ") for line in out.stdout.splitlines())
