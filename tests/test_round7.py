"""Findings of round 4."""

import duckdb

from postlake.plans.catalog import ORACLES, QUERIES


def test_html_text_equals_its_sql_on_odd_pages(spark, tmp_path):
    """pages cut inside a reference, references that SQL leaves, markup that is never closed, and spaces beyond ASCII."""
    cut = [f"<p>a {x[:k]}" for x in ("&quot;", "&amp;", "&copy;", "&lt;", "<!-- b -->", "<script>b</script>", "<head>b</head>") for k in range(1, len(x) + 1)]
    odd = ["&nbsp;&eacute;&#65;&COPY;", "&amp;lt;", "&amp;amp;amp", "<title>t</title>x", "a < b > c", "a<b", '<a title=">">y</a>', "<header>h</header>i<head-x>j</head>k", '<SCRIPT>1</Script ><b>2</script>3', "<ſcript>q</ſCRIPT>z", "\u3000a\u2003 b\xa0", "\x0ba\x1c\n\x85", "\\1 $1", "", None]
    spark.createDataFrame([*enumerate(cut + odd * 20), (None, "<b>c"), (0, "again")], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES["html_text"]).fetchall()
    assert sorted(map(tuple, QUERIES["html_text"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    assert (4, "a &quot") in want and len(want) == len(cut) + len(odd) * 20 + 2
