"""space_restore_regex by brute force on pages longer than any prefix."""

from __future__ import annotations

import re

from glintframe.functions import text as X
from glintframe.plans import all_queries


def test_space_restore_regex_takes_whole_pages(spark, tmp_path):
    pages = [(0, "http://a.b/1", "<p>abc12 x(y)z</p>"), (1, "http://a.b/2", "word " * 900 + "lateWord7 end.Next"), (2, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def brute(text):
        for pattern, to in X.LOST_SPACES:
            text = re.sub(pattern, to.replace("$", "\\"), text)
        return text

    got = {r.page_id: r.spaced for r in all_queries.QUERIES["space_restore_regex"](spark, str(tmp_path)).collect()}
    assert got == {k: None if html is None else brute(url + html.replace(" ", ",")) for k, url, html in pages}
    assert got[1].endswith(", late Word 7, end. Next")
