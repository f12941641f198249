"""DuckDB text of the forum tables, used as the prefix of every oracle query.

The driver registers only the raw tables (events, documents, pages, ...), so
each oracle query carries the CTEs it needs.  The rules are the ones in
``threadlens.sources.forum`` (same fixed values).
"""

from __future__ import annotations

CTES: dict[str, str] = {
    "posts": """
posts as (
  select e.event_id as post_id, e.user_id,
         'user' || cast(e.user_id % 140 as varchar) as user_name,
         d.text as post_text,
         cast(1 + (e.event_id % 100) // 40 as integer) as thread_page,
         e.ts as post_timestamp,
         1000000 + e.event_id // 100 as thread_id,
         cast(44 + (e.event_id // 100) % 4 as integer) as forum_id,
         case when e.k between 1 and e.event_id then
              case when e.event_type = 'purchase' and e.k >= 2
                   then [e.event_id - e.k, e.event_id - e.k // 2]
                   else [e.event_id - e.k] end
              else cast([] as bigint[]) end as quoted_post_ids
  from (select *, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) e
  join documents d on d.doc_id = e.event_id % (select count(*) from documents)
)""",
    "threads": """
threads as (
  select 1000000 + blk as thread_id, 'Thread ' || cast(blk as varchar) as thread_title,
         cast(44 + blk % 4 as integer) as forum_id, 'user' || cast(blk % 140 as varchar) as author,
         blk % 150 as author_id, blk % 7 = 0 as is_ignored
  from (select distinct event_id // 100 as blk from events) x where blk % 11 <> 0
  union all
  select 2000000 + page_id, regexp_extract(html, '<title>([^<]*)</title>', 1),
         cast(44 + page_id % 4 as integer), 'user' || cast(page_id % 140 as varchar),
         page_id % 150, page_id % 5 = 0
  from pages
)""",
    "thread_ignore": """
thread_ignore as (
  select distinct 1000000 + event_id // 100 as thread_id from events where (event_id // 100) % 13 = 0
)""",
    "topic_threads": """
topic_threads as (
  select distinct 'k' || cast((thread_id - 1000000) % 9 as varchar) as key, thread_id from posts
)""",
    "topic_release": """
topic_release as (
  select 'k' || cast(i as varchar) as key, cast(date '2024-01-02' + cast(i as integer) as date) as release_date
  from range(9) t(i)
)""",
}

# Dependencies between the CTEs above.
DEPS: dict[str, list[str]] = {
    "topic_threads": ["posts"],
}

ORDER = ["posts", "threads", "thread_ignore", "topic_threads", "topic_release"]


def with_ctes(body: str, *names: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the named fixture CTEs (plus their dependencies) and extra CTE texts."""
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        for d in DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    parts = [CTES[n].strip() for n in ORDER if n in need]
    parts += [x.strip() for x in (extra or [])]
    if not parts:
        return body.strip()
    return "with " + ",\n".join(parts) + "\n" + body.strip()
