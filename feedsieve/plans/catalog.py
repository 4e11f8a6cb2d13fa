"""The registered queries, one per operator, and the SQL they are checked with.

A query takes ``(spark, sf_dir)`` and runs over the whole of its tables.
"""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.clients import ByPromptClient, RuleClient, TermsClient
from ..functions.fixed_values import HIRING_PROMPT, POST_BASE_URL
from ..functions.replies import HIRING_POST, LabelSpec, build_messages, parse_classification
from ..operators import posts as ops
from ..operators.classify import classify, classify_jobs, classify_labels
from ..operators.extract import extract_post_details, find_posts
from ..operators.html_posts import SelectorSpec
from ..schema import LABELLED_POST, POST
from ..session import file_system, new_table_path
from ..sources.answers import AnswerTable
from ..sources.pages import read_pages, stream_pages
from ..sources.post_tables import (
    PostSink,
    append_core_csv,
    append_posts_csv,
    read_posts_csv,
    write_posts_csv,
)
from ..streaming.dead_letters import replay_dead_letters
from ..streaming.progress import ProgressTable
from ..streaming.repeated_run import run_stream, stop_after_batch
from . import fixtures
from .run import RunOptions, run_once

SOURCE_LABEL = LabelSpec("source_label", "Answer 1 if the text names one of the sources.")
SOURCE_TERMS = ("src1", "src7")
SEARCH = "Hiring resume"
LIMITED_PAGES = 20
LIMITED_POSTS = 10

QUERIES = {}
ORACLES = {}


def query(sql, name=None):
    """Register the function under its name, or another, together with its SQL."""

    def register(function):
        QUERIES[name or function.__name__] = function
        ORACLES[name or function.__name__] = sql
        return function

    return register


# --- SQL building blocks -----------------------------------------------------

_BLANKS_SQL = "||".join(f"chr({ord(c)})" for c in text.PY_WHITESPACE)
_RAW = f"({fixtures.RAW_POSTS_SQL}) r"
_KEYWORD_SQL = (
    "regexp_matches(content, 'hiring|opening|opportunity|position|job|career|vacancy|recruitment"
    "|apply|experience required|skills required|role|responsibilities|qualifications"
    "|immediate joining|urgent hiring|job description', 'i')"
)
_REQUIREMENTS_SQL = "regexp_matches(content, 'requirements?|qualifications?', 'i')"
_EXPERIENCE_SQL = "regexp_matches(content, '\\d+\\+?\\s*years?|years? of experience', 'i')"
_ACTION_SQL = "regexp_matches(content, 'apply|send|email|dm|interested|opportunity', 'i')"
_WORD_SQL = "contains(lower(content), '{}')"
_COUNT_SQL = "+".join(
    f"cast({test} as int)"
    for test in (
        _REQUIREMENTS_SQL,
        _EXPERIENCE_SQL,
        _ACTION_SQL,
        *(_WORD_SQL.format(w) for w in ("resume", "cv", "position", "role")),
    )
)
_JOB_POST_SQL = f"({_KEYWORD_SQL} and ({_COUNT_SQL}) >= 2)"


def _parts_sql(found):
    """Clean posts of a table of found elements."""
    return f"""
select * from (
  select doc_id, page_id, pos,
    trim(content, {_BLANKS_SQL}) as content,
    '{POST_BASE_URL}' || data_urn as url,
    trim(split_part(actor_title, chr(10), 1), {_BLANKS_SQL}) as profile_name
  from ({found}) f
  where content is not null and actor_title is not null and data_urn <> '') c
where content <> ''"""


def _first_sql(posts):
    return f"""
select * from (
  select *, row_number() over (partition by url order by page_id, pos) as n
  from ({posts}) p) q
where n = 1"""


_POSTS_SQL = _parts_sql(fixtures.RAW_POSTS_SQL)
_SCRAPED_SQL = _first_sql(_parts_sql(fixtures.FOUND_SQL))


def _labelled_sql(posts):
    return (
        f"select content, url, profile_name, cast({_JOB_POST_SQL} as bigint) as hiring_post"
        f" from ({posts}) l"
    )


def _per_document_sql(expression, name):
    return f"select page_id, pos, {expression} as {name} from {_RAW}"


def _raw_contents(spark, sf_dir):
    return fixtures.raw_posts(spark, sf_dir, ("page_id", "pos", "content"))


def _posts(spark, sf_dir):
    return extract_post_details(fixtures.raw_posts(spark, sf_dir))


# --- Predicates and the score ------------------------------------------------


@query(_per_document_sql(_KEYWORD_SQL, "matches_job_keyword"))
def matches_job_keyword(spark, sf_dir):
    flag = text.matches_job_keyword("content").alias("matches_job_keyword")
    return _raw_contents(spark, sf_dir).select("page_id", "pos", flag)


@query(_per_document_sql(_REQUIREMENTS_SQL, "has_requirements"))
def has_requirements(spark, sf_dir):
    flag = text.has_requirements("content").alias("has_requirements")
    return _raw_contents(spark, sf_dir).select("page_id", "pos", flag)


@query(_per_document_sql(_EXPERIENCE_SQL, "has_experience"))
def has_experience(spark, sf_dir):
    flag = text.has_experience("content").alias("has_experience")
    return _raw_contents(spark, sf_dir).select("page_id", "pos", flag)


@query(_per_document_sql(_ACTION_SQL, "has_apply_action"))
def has_apply_action(spark, sf_dir):
    flag = text.has_apply_action("content").alias("has_apply_action")
    return _raw_contents(spark, sf_dir).select("page_id", "pos", flag)


@query(
    "select page_id, pos, "
    + ", ".join(
        f"{_WORD_SQL.format(w)} as mentions_{w}" for w in ("resume", "cv", "position", "role")
    )
    + f" from {_RAW}"
)
def mentions_terms(spark, sf_dir):
    return _raw_contents(spark, sf_dir).select(
        "page_id",
        "pos",
        text.mentions_resume("content").alias("mentions_resume"),
        text.mentions_cv("content").alias("mentions_cv"),
        text.mentions_position("content").alias("mentions_position"),
        text.mentions_role("content").alias("mentions_role"),
    )


@query(_per_document_sql(_COUNT_SQL, "indicator_count"))
def indicator_count(spark, sf_dir):
    count = text.indicator_count("content").alias("indicator_count")
    return _raw_contents(spark, sf_dir).select("page_id", "pos", count)


@query(_per_document_sql(_JOB_POST_SQL, "is_job_post"))
def is_job_post(spark, sf_dir):
    flag = text.is_job_post("content").alias("is_job_post")
    return _raw_contents(spark, sf_dir).select("page_id", "pos", flag)


@query(
    f"select is_job_post, count(*) as posts from (select {_JOB_POST_SQL} as is_job_post from {_RAW}) f"
    " group by is_job_post"
)
def job_post_counts(spark, sf_dir):
    """Posts by the outcome of the job-post test."""
    flag = text.is_job_post("content").alias("is_job_post")
    return (
        _raw_contents(spark, sf_dir)
        .select(flag)
        .groupBy("is_job_post")
        .agg(F.count(F.lit(1)).alias("posts"))
    )


# A null content, as the posts without an id have it here, is not relevant.
@query(
    f"select page_id, pos, coalesce({_JOB_POST_SQL}, false) as is_relevant_post from "
    f"(select page_id, pos, case when data_urn is null then null else content end as content"
    f" from {_RAW}) c"
)
def is_relevant_post(spark, sf_dir):
    content = F.when(F.col("data_urn").isNotNull(), F.col("content"))
    return fixtures.raw_posts(spark, sf_dir).select(
        "page_id", "pos", text.is_relevant_post(content).alias("is_relevant_post")
    )


@query(f"select content, url, profile_name from ({_POSTS_SQL}) p where {_JOB_POST_SQL}")
def filter_relevant(spark, sf_dir):
    return ops.filter_relevant(_posts(spark, sf_dir)).select(*POST.names)


@query(
    "select doc_id, contains(lower(text), 'hiring') or contains(lower(text), 'tion')"
    " or contains(lower(text), 'été') as mentions_any from documents"
)
def mentions_any(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flag = text.mentions_any("text", ("hiring", "tion", "été")).alias("mentions_any")
    return documents.select("doc_id", flag)


# --- Extraction --------------------------------------------------------------


@query(f"select page_id, pos, trim(content, {_BLANKS_SQL}) as content from {_RAW}")
def clean_content(spark, sf_dir):
    return _raw_contents(spark, sf_dir).select(
        "page_id", "pos", text.clean_content("content").alias("content")
    )


@query(
    f"select page_id, pos, trim(split_part(actor_title, chr(10), 1), {_BLANKS_SQL})"
    f" as profile_name from {_RAW}"
)
def profile_name(spark, sf_dir):
    return fixtures.raw_posts(spark, sf_dir).select(
        "page_id", "pos", text.profile_name("actor_title").alias("profile_name")
    )


@query(f"select page_id, pos, '{POST_BASE_URL}' || data_urn as url from {_RAW}")
def post_url(spark, sf_dir):
    return fixtures.raw_posts(spark, sf_dir).select(
        "page_id", "pos", text.post_url("data_urn").alias("url")
    )


@query(f"select page_id, pos, content, actor_title, data_urn from ({fixtures.FOUND_SQL}) f", name="find_posts")
def find_posts_on_pages(spark, sf_dir):
    return find_posts(fixtures.pages(spark, sf_dir))


@query(
    f"select page_id, pos, content, url, profile_name from ({_parts_sql(fixtures.FOUND_SQL)}) p",
    name="extract_post_details",
)
def extract_posts(spark, sf_dir):
    return extract_post_details(find_posts(fixtures.pages(spark, sf_dir)))


def _html_text_sql(source):
    """Text of a snippet without tags; ``&amp`` counts without its semicolon too.

    Text counts as it is shown: a run of blanks is one, and none stand at the ends.
    """
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        source = f"replace({source}, '{entity}', '{char}')"
    source = f"regexp_replace({source}, '&amp;?', '&', 'g')"
    return f"trim(regexp_replace({source}, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')"


@query(
    f"""select page_id, 0 as pos,
{_html_text_sql("regexp_extract(html, '<article><h1>([^<]*)', 1)")} as content,
{_html_text_sql("regexp_extract(html, '<a href=./[^>]*>([^<]*)', 1)")} as actor_title,
regexp_extract(html, '<html lang="([^"]*)', 1) as data_urn from pages"""
)
def extract_custom_selectors(spark, sf_dir):
    """The given web pages, with selectors that fit them."""
    spec = SelectorSpec(
        containers=("div.feed", "html[lang]"),
        content="h1",
        actor_title="a[href^='/']",
        id_attribute="lang",
    )
    return find_posts(read_pages(spark, f"{sf_dir}/pages.parquet"), spec)


@query("select page_id, url, html from pages", name="read_pages")
def pages_table(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet")


@query("select page_id, url, html from pages", name="stream_pages")
def pages_as_stream(spark, sf_dir):
    """The pages as a stream of files, two per batch, copied to a table."""
    arriving, copied = new_table_path(spark, "arriving"), new_table_path(spark, "copied")
    read_pages(spark, f"{sf_dir}/pages.parquet").repartition(4).write.parquet(arriving)
    writer = stream_pages(spark, arriving, max_files=2).writeStream.format("parquet")
    writer = writer.option("checkpointLocation", new_table_path(spark, "copied_state"))
    writer.trigger(availableNow=True).start(copied).awaitTermination()
    return read_pages(spark, copied)


# --- Search, order, limit, de-duplication, union -----------------------------


@query(
    f"select content, url, profile_name from ({_POSTS_SQL}) p"
    " where contains(lower(content), 'hiring') and contains(lower(content), 'resume')"
)
def search_posts(spark, sf_dir):
    return ops.search_posts(_posts(spark, sf_dir), SEARCH).select(*POST.names)


@query(
    f"select page_id, pos, url, posted_at, row_number() over (order by posted_at desc, url)"
    f" as position from (select page_id, pos, '{POST_BASE_URL}' || data_urn as url, posted_at"
    f" from {_RAW}) p where url is not null"
)
def latest_first(spark, sf_dir):
    columns = ("page_id", "pos", "data_urn", "posted_at")
    posts = fixtures.raw_posts(spark, sf_dir, columns).select(
        "page_id", "pos", text.post_url("data_urn").alias("url"), "posted_at"
    )
    ordered = ops.latest_first(posts.where(F.col("url").isNotNull()), "posted_at")
    return ops.with_position(ordered)


@query(
    "select page_id, url, cast(length(html) as int) as html_length from pages"
    f" order by page_id limit {LIMITED_PAGES}"
)
def limit_pages(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    return ops.limit_pages(pages, LIMITED_PAGES).select(
        "page_id", "url", F.length("html").alias("html_length")
    )


@query(
    f"select page_id, pos, url from ({_POSTS_SQL}) p order by page_id, pos limit {LIMITED_POSTS}"
)
def limit_posts(spark, sf_dir):
    return ops.limit_posts(_posts(spark, sf_dir), LIMITED_POSTS).select("page_id", "pos", "url")


@query(f"select page_id, pos, content, url, profile_name from ({_first_sql(_POSTS_SQL)}) p")
def dedup_posts(spark, sf_dir):
    return ops.first_per_url(_posts(spark, sf_dir))


@query(
    f"select content, url, profile_name, null as hiring_post from ({_POSTS_SQL}) p"
    f" union all select * from ({_labelled_sql(_POSTS_SQL)}) q"
)
def union_posts(spark, sf_dir):
    """Rows without a label, then the same rows with one."""
    old = _posts(spark, sf_dir).select(*POST.names)
    new = old.withColumn("hiring_post", text.is_job_post("content").cast("bigint"))
    return ops.union_posts(old, new)


@query(
    f"select (select count(*) from ({fixtures.FOUND_SQL}) f) as found,"
    f" (select count(*) from ({_parts_sql(fixtures.FOUND_SQL)}) p) as extracted,"
    f" n as scraped, n as classified, n as appended, n as total"
    f" from (select count(*) as n from ({_SCRAPED_SQL}) s) t"
)
def stage_counts(spark, sf_dir):
    """Rows per stage, observed while one run executes, and rows stored."""
    sink = PostSink(new_table_path(spark, "stage_counts"))
    counts = run_once(fixtures.pages(spark, sf_dir), RuleClient(), sink)
    counts["total"] = sink.total(spark)
    schema = ", ".join(f"{stage} bigint" for stage in counts)
    return spark.createDataFrame([tuple(counts.values())], schema)


# --- Labelling ---------------------------------------------------------------

_PROMPT_SQL = HIRING_PROMPT.replace("'", "''")


@query(
    f"select page_id, pos, 2 as messages, 'system' as first_role, '{_PROMPT_SQL}' as first_content,"
    f" 'user' as second_role, content as second_content from {_RAW}",
    name="build_messages",
)
def messages(spark, sf_dir):
    built = _raw_contents(spark, sf_dir).select(
        "page_id", "pos", build_messages(HIRING_PROMPT, "content").alias("m")
    )
    return built.select(
        "page_id",
        "pos",
        F.size("m").alias("messages"),
        F.col("m")[0]["role"].alias("first_role"),
        F.col("m")[0]["content"].alias("first_content"),
        F.col("m")[1]["role"].alias("second_role"),
        F.col("m")[1]["content"].alias("second_content"),
    )


# Reply forms around the document's number: (SQL of the reply, SQL of the label).
# A null label stands for a refused reply.
_REPLY_FORMS = (
    ("'{\"classification\": ' || doc_id || '}'", "doc_id"),
    ("'{\"classification\": -' || doc_id || '}'", "-doc_id"),
    ("'{\"classification\": \"' || doc_id || '\"}'", "doc_id"),
    ("'{\"classification\": \" 0' || doc_id || ' \"}'", "doc_id"),
    ("'{\"classification\": \"+' || doc_id || '.0\"}'", "doc_id"),
    ("'{\"classification\": ' || doc_id || '.0}'", "doc_id"),
    ("'{\"classification\": ' || doc_id || 'e0}'", "doc_id"),
    ("'{\"classification\": true, \"doc\": ' || doc_id || '}'", "1"),
    ("' {\"doc\": ' || doc_id || ', \"classification\": 0, \"classification\": 1}'", "1"),
    ("'{\"classification\": ' || doc_id || '.5}'", "null"),
    ("'{\"classification\": \"' || doc_id || 'e0\"}'", "null"),
    ("'{\"classification\": null, \"doc\": ' || doc_id || '}'", "null"),
    ("'{\"classification\": \"yes\", \"doc\": ' || doc_id || '}'", "null"),
    ("'{\"classification\": [' || doc_id || ']}'", "null"),
    ("'{\"Classification\": ' || doc_id || '}'", "null"),
    ("'{\"classification\": ' || doc_id || '} ok'", "null"),
    ("'{''classification'': ' || doc_id || '}'", "null"),
    ("'```json{\"classification\": ' || doc_id || '}```'", "null"),
    ("'{\"classification\": ' || doc_id || ',}'", "null"),
    ("'[' || doc_id || ']'", "null"),
    ("text", "null"),
    ("''", "null"),
)


def _by_form(index):
    cases = " ".join(f"when {n} then {form[index]}" for n, form in enumerate(_REPLY_FORMS))
    return f"case doc_id % {len(_REPLY_FORMS)} {cases} end"


@query(
    "select doc_id, label as classification, label is null as refused from"
    f" (select doc_id, cast({_by_form(1)} as bigint) as label from documents) l",
    name="parse_classification",
)
def parse_replies(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    replies = documents.selectExpr("doc_id", f"{_by_form(0)} as reply")
    parsed = replies.select("doc_id", parse_classification("reply").alias("p"))
    return parsed.select(
        "doc_id",
        F.col("p.classification").alias("classification"),
        F.col("p.error").isNotNull().alias("refused"),
    )


@query(_labelled_sql(_first_sql(_POSTS_SQL)), name="classify_jobs")
def classify_hiring(spark, sf_dir):
    posts = ops.first_per_url(_posts(spark, sf_dir)).select(*POST.names)
    return classify_jobs(posts, RuleClient())


_SOURCE_SQL = " or ".join(f"contains(lower(profile_name), '{term}')" for term in SOURCE_TERMS)


@query(f"select url, profile_name, cast({_SOURCE_SQL} as bigint) as source_label from ({_POSTS_SQL}) p")
def classify_column(spark, sf_dir):
    """Another column under another prompt."""
    posts = _posts(spark, sf_dir).select("url", "profile_name")
    return classify(posts, "profile_name", SOURCE_LABEL, TermsClient(SOURCE_TERMS))


@query(f"select url, profile_name, cast({_SOURCE_SQL} as bigint) as source_label from ({_POSTS_SQL}) p")
def classify_distinct(spark, sf_dir):
    """The same, asking once per distinct text."""
    posts = _posts(spark, sf_dir).select("url", "profile_name")
    client = TermsClient(SOURCE_TERMS)
    return classify(posts, "profile_name", SOURCE_LABEL, client, reuse_answers=True)


# The input is empty for the posts without an id.
@query(
    f"select page_id, pos, case when data_urn is null then null else cast({_JOB_POST_SQL} as bigint)"
    f" end as hiring_post, case when data_urn is null then 'empty_input' end as error from {_RAW}"
)
def classify_quarantine(spark, sf_dir):
    content = F.when(F.col("data_urn").isNotNull(), F.col("content")).otherwise(F.lit(""))
    rows = fixtures.raw_posts(spark, sf_dir).select("page_id", "pos", content.alias("content"))
    return classify_jobs(rows, RuleClient(), on_error="quarantine").drop("content")


# --- Tables, runs, streams ---------------------------------------------------

# Bytes of posts in an arriving file, and what a post has around its text.
FILE_BYTES = 32 << 20
POST_MARKUP = 256


def _files_per_batch(spark, sf_dir, batches, number=None):
    """Files that the pages of the largest batch need; without a ``number`` all are alike."""
    posts = fixtures.raw_posts(spark, sf_dir, ("page_id", "content"))
    size = F.coalesce(F.octet_length("content"), F.lit(0)) + POST_MARKUP
    sizes = posts.groupBy((F.lit(0) if number is None else number).alias("number")).agg(F.sum(size).alias("bytes"))
    most = sizes.agg(F.max("bytes")).first()[0] or 0
    return max(1, -(-most // (FILE_BYTES * (batches if number is None else 1))))


def _page_ranges(spark, sf_dir, batches):
    """The pages as files that hold a range of them, and the files in a batch."""
    arriving = new_table_path(spark, "arriving_pages")
    n_files = _files_per_batch(spark, sf_dir, batches)
    fixtures.pages(spark, sf_dir).repartitionByRange(batches * n_files, "page_id").write.parquet(arriving)
    return arriving, n_files


@query(_labelled_sql(_POSTS_SQL))
def csv_roundtrip(spark, sf_dir):
    path = new_table_path(spark, "csv_roundtrip")
    posts = _posts(spark, sf_dir).select(*POST.names)
    labelled = posts.withColumn("hiring_post", text.is_job_post("content").cast("bigint"))
    write_posts_csv(labelled, path)
    return read_posts_csv(spark, path)


@query(
    f"select content, url, profile_name from ({_POSTS_SQL}) p"
    f" union all select content, url, profile_name from ({_POSTS_SQL}) q",
    name="append_core_csv",
)
def append_core(spark, sf_dir):
    path = new_table_path(spark, "append_core")
    posts = _posts(spark, sf_dir)
    append_core_csv(posts, path)
    append_core_csv(posts, path)
    return read_posts_csv(spark, path, POST)


@query(
    f"select content, url, profile_name, null as hiring_post from ({_POSTS_SQL}) p"
    f" union all select * from ({_labelled_sql(_POSTS_SQL)}) q",
    name="append_posts_csv",
)
def append_posts(spark, sf_dir):
    """Unlabelled rows first, then labelled ones: the columns differ."""
    posts = _posts(spark, sf_dir).select(*POST.names)
    first = new_table_path(spark, "append_posts")
    append_posts_csv(posts, first)
    labelled = posts.withColumn("hiring_post", text.is_job_post("content").cast("bigint"))
    return append_posts_csv(labelled, first, new_table_path(spark, "append_posts_union"))


@query(_labelled_sql(_SCRAPED_SQL), name="run_once")
def run_pages_once(spark, sf_dir):
    sink = PostSink(new_table_path(spark, "run_once"))
    run_once(fixtures.pages(spark, sf_dir), RuleClient(), sink)
    return sink.read(spark)


@query(_labelled_sql(_first_sql(_parts_sql(fixtures.FOUND_SQL))) + f" where {_JOB_POST_SQL}")
def run_relevant_only(spark, sf_dir):
    """A run into CSV that keeps only the posts that pass the test."""
    sink = PostSink(new_table_path(spark, "run_relevant"), "csv")
    run_once(fixtures.pages(spark, sf_dir), RuleClient(), sink, RunOptions(only_relevant=True))
    return sink.read(spark)


@query(_labelled_sql(_SCRAPED_SQL), name="run_stream")
def run_pages_stream(spark, sf_dir):
    """The pages as files of a stream; copies of a url share a page, so a batch."""
    arriving, n_files = _page_ranges(spark, sf_dir, 3)
    sink = PostSink(new_table_path(spark, "run_stream"))
    state = new_table_path(spark, "run_stream_state")
    run_stream(spark, arriving, RuleClient(), sink, state, max_files=n_files).awaitTermination()
    return sink.read(spark, LABELLED_POST)


def _backfill_then_stream(spark, sf_dir, format):
    """One run over the pages, then a stream of the same pages into the same sink."""
    arriving, n_files = _page_ranges(spark, sf_dir, 2)
    sink = PostSink(new_table_path(spark, "backfill"), format)
    run_once(read_pages(spark, arriving), RuleClient(), sink)
    state = new_table_path(spark, "backfill_state")
    run_stream(spark, arriving, RuleClient(), sink, state, max_files=n_files).awaitTermination()
    return sink.read(spark)


_TWICE_SQL = f"{_labelled_sql(_SCRAPED_SQL)} union all {_labelled_sql(_SCRAPED_SQL)}"


@query(_TWICE_SQL)
def run_backfill_then_stream(spark, sf_dir):
    return _backfill_then_stream(spark, sf_dir, "parquet")


@query(_TWICE_SQL)
def run_backfill_then_stream_csv(spark, sf_dir):
    return _backfill_then_stream(spark, sf_dir, "csv")


@query(_TWICE_SQL)
def run_two_streams(spark, sf_dir):
    """Two streams, each with its own checkpoint, into one sink."""
    arriving, n_files = _page_ranges(spark, sf_dir, 2)
    sink = PostSink(new_table_path(spark, "two_streams"))
    for _ in range(2):
        state = new_table_path(spark, "two_streams_state")
        run_stream(spark, arriving, RuleClient(), sink, state, max_files=n_files).awaitTermination()
    return sink.read(spark)


@query(f"select content, url, profile_name, null as hiring_post from ({_POSTS_SQL}) p where false")
def run_without_posts(spark, sf_dir):
    """A run over the given pages, which hold no posts: an empty table, no failure."""
    sink = PostSink(new_table_path(spark, "no_posts"))
    run_once(read_pages(spark, f"{sf_dir}/pages.parquet"), RuleClient(), sink)
    return sink.read(spark)


# --- Several labels, answers that are kept -----------------------------------

LABELS = (("content", HIRING_POST), ("profile_name", SOURCE_LABEL))
LABELS_CLIENT = ByPromptClient(
    ((HIRING_POST.prompt, RuleClient()), (SOURCE_LABEL.prompt, TermsClient(SOURCE_TERMS)))
)


def _two_labels_sql(posts):
    return (
        f"select content, url, profile_name, cast({_JOB_POST_SQL} as bigint) as hiring_post,"
        f" cast({_SOURCE_SQL} as bigint) as source_label from ({posts}) l"
    )


@query(_two_labels_sql(_SCRAPED_SQL))
def run_two_labels(spark, sf_dir):
    """A run that asks for two labels in one pass over the posts."""
    sink, options = PostSink(new_table_path(spark, "two_labels")), RunOptions(labels=LABELS, in_flight=4)
    run_once(fixtures.pages(spark, sf_dir), LABELS_CLIENT, sink, options)
    return sink.read(spark, options.schema())


@query(_two_labels_sql(_POSTS_SQL) + " where doc_id % 2 = 0")
def classify_kept_answers(spark, sf_dir):
    """Labels of half the posts, from answers that were kept when all were asked for."""
    answers = AnswerTable(new_table_path(spark, "answers"))
    posts = _posts(spark, sf_dir).withColumn("doc_id", F.col("page_id") * fixtures.POSTS_PER_PAGE + F.col("pos"))
    posts = posts.drop("page_id", "pos")
    classify_labels(posts, LABELS, LABELS_CLIENT, answers=answers)
    half = posts.where("doc_id % 2 = 0").drop("doc_id")
    return classify_labels(half, LABELS, _Unasked(), answers=answers)


class _Unasked:
    """A client that must not be asked."""

    def __call__(self):
        def refuse(requests, schema):
            raise RuntimeError("all answers should have been kept")

        return refuse


@query(
    "select doc_id, 'Label' as title, 'object' as type, 'classification' as required, 'integer' as field_type"
    " from documents"
)
def label_schema(spark, sf_dir):
    """What a reply has to look like, per request."""
    schema = LabelSpec("label", HIRING_PROMPT).json_schema()
    (required,) = schema["required"]
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        F.lit(schema["title"]).alias("title"),
        F.lit(schema["type"]).alias("type"),
        F.lit(required).alias("required"),
        F.lit(schema["properties"][required]["type"]).alias("field_type"),
    )


# --- Repeated runs that fail, stop and go on -----------------------------------

STREAM_FILES = 3


def _arrived(spark, path):
    """Files in a folder of pages, in the order in which they came."""
    files, folder = file_system(spark, path)
    found = [s for s in files.listStatus(folder) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return sorted(found, key=lambda status: status.getModificationTime())


def _page_files(spark, sf_dir):
    """The pages as equally many files per remainder of the page number, in that order.

    Returns the folder and the files per remainder, which are a batch of the stream.
    """
    arriving = new_table_path(spark, "arriving_pages")
    pages, remainder = fixtures.pages(spark, sf_dir), F.col("page_id") % STREAM_FILES
    n_files = _files_per_batch(spark, sf_dir, STREAM_FILES, remainder)
    for n in range(STREAM_FILES):
        part = pages.where(remainder == n)
        part.repartition(n_files, "page_id").write.mode("append").parquet(arriving)
        # A partition without pages writes no file; one without pages stands in for it.
        for _ in range((n + 1) * n_files - len(_arrived(spark, arriving))):
            part.limit(0).coalesce(1).write.mode("append").parquet(arriving)
    return arriving, n_files


def _batches_sql(found, where="true"):
    """First post per url within each batch."""
    return f"""
select * from (
  select *, row_number() over (partition by page_id % {STREAM_FILES}, url order by page_id, pos) as n
  from ({found}) p) q
where n = 1 and {where}"""


_BATCHES_SQL = _batches_sql(_parts_sql(fixtures.FOUND_SQL))


class _FailsOn:
    """The rule, but no answer to texts that hold a text."""

    def __init__(self, word):
        self.word = word

    def __call__(self):
        answer = RuleClient()()

        def ask(requests, schema):
            if any(self.word in request[-1]["content"] for request in requests):
                raise OSError("no answer")
            return answer(requests, schema)

        return ask


def _failing_stream(spark, sf_dir, replay):
    """A stream whose second batch fails, and the replay of what it leaves."""
    (arriving, n_files), dead = _page_files(spark, sf_dir), new_table_path(spark, "dead_letters")
    sink = PostSink(new_table_path(spark, "failing_stream"))
    state = new_table_path(spark, "failing_stream_state")
    # The first post of the second batch is the one without an answer.
    second = fixtures.pages(spark, sf_dir).where("page_id = 1")
    first = extract_post_details(find_posts(second)).orderBy("pos").first()
    client = _FailsOn(first.content)
    run_stream(
        spark, arriving, client, sink, state, max_files=n_files, on_batch_error="dead_letter", dead_letter_path=dead
    ).awaitTermination()
    if replay:
        for _ in range(2):
            replay_dead_letters(spark, dead, RuleClient(), sink)
        return sink.read(spark)
    return read_pages(spark, f"{dead}/*/*").select("page_id", "url")


@query(
    f"select distinct page_id, 'http://feed.example.com/' || page_id as url from {_RAW}"
    f" where page_id % {STREAM_FILES} = 1"
)
def stream_dead_letters(spark, sf_dir):
    """The pages that a failed batch leaves."""
    return _failing_stream(spark, sf_dir, replay=False)


@query(_labelled_sql(_BATCHES_SQL))
def stream_replay(spark, sf_dir):
    """A stream after its failed batch has been replayed, twice over: each post once."""
    return _failing_stream(spark, sf_dir, replay=True)


@query(_labelled_sql(_BATCHES_SQL))
def stream_stopped(spark, sf_dir):
    """A stream stopped after each batch and started again from its checkpoint."""
    (arriving, n_files), sink = _page_files(spark, sf_dir), PostSink(new_table_path(spark, "stopped_stream"))
    state = new_table_path(spark, "stopped_stream_state")
    for _ in range(STREAM_FILES):
        query = run_stream(spark, arriving, RuleClient(), sink, state, max_files=n_files)
        query.awaitTermination(1)
        stop_after_batch(query)
    run_stream(spark, arriving, RuleClient(), sink, state, max_files=n_files).awaitTermination()
    return sink.read(spark)


@query(
    f"""select b as batch_id, 'stored' as outcome,
  (select count(*) from ({fixtures.FOUND_SQL}) f where page_id % {STREAM_FILES} = b) as found,
  (select count(*) from ({_parts_sql(fixtures.FOUND_SQL)}) p where page_id % {STREAM_FILES} = b) as extracted,
  (select count(*) from ({_BATCHES_SQL}) s where page_id % {STREAM_FILES} = b) as scraped,
  (select count(*) from ({_BATCHES_SQL}) s where page_id % {STREAM_FILES} = b) as stored
from (select unnest(range({STREAM_FILES})) as b) r"""
)
def batch_progress(spark, sf_dir):
    """Rows per stage and rows stored, by number of the batch."""
    (arriving, n_files), sink = _page_files(spark, sf_dir), PostSink(new_table_path(spark, "progress_stream"))
    progress = ProgressTable(new_table_path(spark, "progress"))
    run_stream(
        spark, arriving, RuleClient(), sink, new_table_path(spark, "progress_state"), max_files=n_files,
        options=RunOptions(exact_counts=True), progress=progress,
    ).awaitTermination()
    return progress.read(spark).select("batch_id", "outcome", "found", "extracted", "scraped", "stored")


@query(f"select page_id % {STREAM_FILES} as batch_id, content, url, profile_name from ({_BATCHES_SQL}) b")
def stream_batch_numbers(spark, sf_dir):
    """The stored posts with the number of the batch they came in."""
    (arriving, n_files), sink = _page_files(spark, sf_dir), PostSink(new_table_path(spark, "numbered_stream"), "csv")
    state = new_table_path(spark, "numbered_state")
    run_stream(spark, arriving, RuleClient(), sink, state, max_files=n_files).awaitTermination()
    return sink.read(spark, batches=True).select("batch_id", *POST.names)


@query(_labelled_sql(_BATCHES_SQL))
def stream_backlog(spark, sf_dir):
    """A backlog taken in batches of bounded bytes: those of the largest remainder.

    Copies of a url share a page, so a batch, also where remainders differ in size.
    """
    (arriving, n_files), sink = _page_files(spark, sf_dir), PostSink(new_table_path(spark, "backlog"))
    state = new_table_path(spark, "backlog_state")
    sizes = [status.getLen() for status in _arrived(spark, arriving)]
    most = max(sum(sizes[n : n + n_files]) for n in range(0, len(sizes), n_files))
    run_stream(spark, arriving, RuleClient(), sink, state, max_bytes=most).awaitTermination()
    return sink.read(spark)


@query(
    f"select content, url, profile_name, null as hiring_post, null as source_label from ({_SCRAPED_SQL}) p"
    f" union all select * from ({_two_labels_sql(_SCRAPED_SQL)}) q"
)
def append_new_column(spark, sf_dir):
    """A run that adds labels to a CSV sink that has none."""
    sink, options = PostSink(new_table_path(spark, "new_column"), "csv"), RunOptions(labels=LABELS)
    pages = fixtures.pages(spark, sf_dir)
    posts = ops.first_per_url(extract_post_details(find_posts(pages))).select(*POST.names)
    sink.write(posts)
    run_once(pages, LABELS_CLIENT, sink, options)
    return sink.read(spark, options.schema())
