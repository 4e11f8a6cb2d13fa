"""Extraction: pages to raw posts, raw posts to posts."""

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed_values import POST_BASE_URL
from ..schema import RAW_POST
from .html_posts import PostFinder, SelectorSpec

# Characters of post text after which a task hands on what it has found.
_FLUSH_CHARS = 8_000_000

_RAW_POST_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("pos", pa.int32()),
        ("content", pa.string()),
        ("actor_title", pa.string()),
        ("data_urn", pa.string()),
    ]
)


def find_posts(pages, selectors=SelectorSpec()):
    """Raw posts of each page, ``pos`` counting from 0 in document order.

    HTML cannot be taken apart by built-in expressions, so this is the one step
    of extraction that runs in Python, over Arrow batches and without a shuffle.
    Columns are not pruned through it, hence the select in front.
    """

    def run(batches):
        finder = PostFinder(selectors)
        rows, held = [], 0
        for batch in batches:
            page_ids, htmls = batch.column("page_id"), batch.column("html")
            # One page at a time: a batch holds many megabytes of HTML.
            for page_id, html in zip(page_ids, htmls):
                found = finder.find(html.as_py() or "")
                for pos, (content, title, urn) in enumerate(found):
                    rows.append((page_id.as_py(), pos, content, title, urn))
                    held += len(content or "") + len(title or "")
                if held >= _FLUSH_CHARS:
                    yield _to_batch(rows)
                    rows, held = [], 0
        if rows:
            yield _to_batch(rows)

    return pages.select("page_id", "html").mapInArrow(run, RAW_POST)


def _to_batch(rows):
    columns = zip(*rows)
    arrays = [pa.array(values, f.type) for values, f in zip(columns, _RAW_POST_ARROW)]
    return pa.RecordBatch.from_arrays(arrays, schema=_RAW_POST_ARROW)


def extract_post_details(raw_posts, base_url=POST_BASE_URL):
    """Posts of the raw posts that have content, an actor title and an id.

    A post that lacks one of them is dropped by itself; an actor title may be
    empty.  Built-in expressions only.
    """
    return (
        raw_posts.dropna(subset=["content", "actor_title", "data_urn"])
        .where(F.col("data_urn") != "")
        .select(
            "page_id",
            "pos",
            text.clean_content("content").alias("content"),
            text.post_url("data_urn", base_url).alias("url"),
            text.profile_name("actor_title").alias("profile_name"),
        )
        .where(F.col("content") != "")
    )
