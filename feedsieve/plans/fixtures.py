"""Post tables derived from the given ``documents`` table.

The texts there are invented words without any job keyword, so a phrase is put
behind each to make every rule of the score fire.  The SQL below is plain
enough to run unchanged in Spark and in the SQL engine the results are checked
with.
"""

from pyspark.sql import functions as F

# Documents per derived page; bounds the group a page is put together from.
POSTS_PER_PAGE = 20

# doc_id is unique, so page_id and pos say where a post stands.
RAW_POSTS_SQL = f"""
select doc_id,
  cast(floor(doc_id / {POSTS_PER_PAGE}) as bigint) as page_id,
  cast(doc_id % {POSTS_PER_PAGE} as int) as pos,
  text || ' ' || case doc_id % 8
    when 0 then ''
    when 1 then 'We are hiring. Send your resume.'
    when 2 then 'Hiring!'
    when 3 then '5+ years in this role'
    when 4 then 'Send me your resume'
    when 5 then 'Job requirements: email your CV'
    when 6 then 'admin position'
    else 'Great career move' end as content,
  case when doc_id % 11 = 0 then null
       else 'urn:li:activity:' || cast(case when doc_id % 10 = 9 then doc_id - 1
                                            else doc_id end as varchar(20)) end as data_urn,
  ' ' || source || chr(10) || '2nd degree' as actor_title,
  1700000000 + (doc_id * 7919) % 1000003 as posted_at
from documents"""

# Page layouts, by page_id % 5.  The first container selector that matches
# anything on a page is the only one that counts there.
_LAYOUTS = {
    1: "as 0, with indented markup and spans inside the parts",
    2: "third selector only",
    3: "first selector for even documents, third for odd ones, which are not found",
    4: "second selector only: elements without content and id",
}


def raw_posts(spark, sf_dir, columns=("page_id", "pos", "content", "actor_title", "data_urn")):
    """The posts as rows, with those of the columns that are asked for."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(
        RAW_POSTS_SQL.replace("from documents", "from {documents}"), documents=documents
    ).select(*columns)


def _escaped(column):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        column = F.replace(column, F.lit(char), F.lit(entity))
    return column


def pages(spark, sf_dir):
    """The posts as HTML pages of ``POSTS_PER_PAGE`` posts each."""
    posts = raw_posts(spark, sf_dir, ("doc_id", "page_id", "content", "actor_title", "data_urn"))
    layout = F.col("page_id") % 5
    odd = F.col("doc_id") % 2 == 1
    id_attribute = F.coalesce(F.concat(F.lit(' data-urn="'), "data_urn", F.lit('"')), F.lit(""))
    marker = (
        F.when(layout == 4, F.lit('class="update-components-actor"'))
        .when(
            (layout == 2) | ((layout == 3) & odd),
            F.concat(F.lit('class="card"'), id_attribute),
        )
        .otherwise(F.concat(F.lit('class="feed-shared-update-v2 x"'), id_attribute))
    )

    def indented(column):
        around = (F.lit("\n    <span>\n\t  "), column, F.lit("\r\n    </span>\n"))
        return F.when(layout == 1, F.concat(*around)).otherwise(column)

    title = indented(F.replace(_escaped(F.col("actor_title")), F.lit("\n"), F.lit("<br>")))
    body = F.when(
        layout != 4,
        F.concat(
            F.lit('<span class="break-words">'),
            indented(_escaped(F.col("content"))),
            F.lit("</span>"),
        ),
    ).otherwise(F.lit(""))
    element = F.concat(
        F.lit("<div "),
        marker,
        F.lit('><span class="update-components-actor__title">'),
        title,
        F.lit("</span>"),
        body,
        F.lit("</div>"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("doc_id", element.alias("element"))))
    head = (
        '<!DOCTYPE html><html><head><title>feed</title><script>var t=\'<div class="'
        "feed-shared-update-v2\">';</script></head><body><nav><a title=\"a > b\" href=/x>x</a>"
        '</nav><!-- <div class="feed-shared-update-v2"></div> --><main>'
    )
    return (
        posts.groupBy("page_id")
        .agg(in_order.alias("posts"))
        .select(
            "page_id",
            F.concat(F.lit("http://feed.example.com/"), "page_id").alias("url"),
            F.concat(
                F.lit(head),
                F.array_join(F.transform("posts", lambda p: p["element"]), ""),
                F.lit("</main></body></html>"),
            ).alias("html"),
        )
    )


# What the extraction has to find on those pages: text as it is shown.
FOUND_SQL = rf"""
select doc_id, page_id,
  cast(row_number() over (partition by page_id order by doc_id) - 1 as int) as pos,
  case when page_id % 5 = 4 then null
    else trim(regexp_replace(content, '[ \t\n\f\r]+', ' ', 'g'), ' ') end as content,
  trim(actor_title, ' ') as actor_title,
  case when page_id % 5 = 4 then null else data_urn end as data_urn
from ({RAW_POSTS_SQL}) r
where case page_id % 5
  when 2 then data_urn is not null
  when 3 then doc_id % 2 = 0
  else true end"""
