"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.bpe import encode
from lumenlake.llm.common import table
from lumenlake.llm.embedding_dedup import near_vectors
from lumenlake.llm.exact_dedup import exact_duplicates
from lumenlake.llm.language_id import identify
from lumenlake.llm.minhash import near_duplicates
from lumenlake.llm.mixing import mix
from lumenlake.llm.pii import digests, personal_data
from lumenlake.llm.ranked_search import search
from lumenlake.llm.resampling import resample
from lumenlake.llm.sharding import shard_documents
from lumenlake.llm.substring_dedup import repeated_passages
from lumenlake.llm.token_counts import count_tokens
from lumenlake.llm.url_filter import filter_captures, host

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(personal_data(table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts of pages: additions, removals and additions anew."""
    hosts = pages.select(host(F.col("url")).alias("h")).filter("h is not null").distinct()
    draws = hosts.select("h", F.regexp_replace("h", r"^(www|blog|m)\.", "").alias("d"))
    of = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    doms = draws.select("d").distinct().withColumn("v", of(F.col("d")))
    blogs = draws.filter("h like 'blog.%'").withColumn("v", of(F.col("h")))
    at = lambda days: F.timestamp_add("DAY", F.expr(days), F.lit("2024-01-01").cast("timestamp"))
    entry = lambda df, p, action, category, days: df.select(F.col(p).alias("pattern"), F.lit(action).alias("action"), F.lit(category).alias("category"), at(days).alias("at"))
    return (
        entry(doms.filter("v % 3 = 0"), "d", "add", "spam", "v % 300")
        .unionByName(entry(doms.filter("v % 6 = 0"), "d", "remove", None, "v % 300 + 30 + v % 90"))
        .unionByName(entry(doms.filter("v % 15 = 0"), "d", "add", "malware", "v % 300 + 200"))
        .unionByName(entry(blogs.filter("v % 4 = 1"), "h", "add", "adult", "v % 200"))
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch times and no list comes with it: both are derived from page_id and hosts."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.timestamp_add("HOUR", F.pmod(F.col("page_id") * 7919, F.lit(8760)).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    found = filter_captures(pages.select(F.col("page_id").alias("id"), "url", fetched.alias("fetched")), list_entries(pages))
    return found.select(F.col("id").alias("page_id"), "url", F.date_format("fetched", "yyyy-MM-dd HH").alias("fetched"), "blocked", "pattern", "category")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_shard": op5_shard,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_minhash": op7_minhash,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_resample": op12_resample,
    "op13_token_counts": op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        with n as (select doc_id, length(coalesce(text, '')) as cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
        r as (select *, row_number() over (partition by norm order by cp desc, doc_id) as rn, count(*) over (partition by norm) as group_size from n),
        k as (select norm, doc_id as keep_id, cp as keep_cp from r where rn = 1)
        select r.doc_id, k.keep_id, r.group_size, r.rn = 1 as kept, sha256(r.norm) as text_sha256
        from r join k using (norm)""",
    "op9_url_filter": r"""
        with p as (select page_id, url, timestamp '2024-01-01' + to_hours(cast((page_id * 7919) % 8760 as integer)) as fetched,
                nullif(rtrim(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') as h from pages),
        hosts as (select distinct h, regexp_replace(h, '^(www|blog|m)\.', '') as d from p where h is not null),
        doms as (select distinct d, cast('0x' || substr(md5(d), 1, 6) as integer) as v from hosts),
        blogs as (select h, cast('0x' || substr(md5(h), 1, 6) as integer) as v from hosts where h like 'blog.%'),
        entries as (
            select d as pattern, true as is_on, 'spam' as category, v % 300 as days from doms where v % 3 = 0
            union all select d, false, null, v % 300 + 30 + v % 90 from doms where v % 6 = 0
            union all select d, true, 'malware', v % 300 + 200 from doms where v % 15 = 0
            union all select h, true, 'adult', v % 200 from blogs where v % 4 = 1),
        one as (select pattern, days, max(is_on::int) as is_on, max(category) filter (where is_on) as category from entries group by pattern, days),
        spans as (select pattern, category, is_on, timestamp '2024-01-01' + to_days(cast(days as integer)) as since,
                timestamp '2024-01-01' + to_days(cast(lead(days) over (partition by pattern order by days) as integer)) as until from one),
        hits as (select p.page_id, s.pattern, s.category, row_number() over (partition by p.page_id order by -len(string_split(s.pattern, '.')), s.pattern) as rn
            from p join spans s on (p.h = s.pattern or ends_with(p.h, '.' || s.pattern)) and s.is_on = 1 and s.since <= p.fetched and (s.until is null or p.fetched < s.until))
        select p.page_id, p.url, strftime(p.fetched, '%Y-%m-%d %H') as fetched, hits.page_id is not null as blocked, hits.pattern, hits.category
        from p left join hits on hits.page_id = p.page_id and hits.rn = 1""",
    "op3_mix_sources": r"""
        with n as (select doc_id, source, text, coalesce(doc_id::varchar, 'text ' || md5(coalesce(text, ''))) as name from documents),
        d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                cast('0x' || substr(md5('42:' || name), 1, 8) as bigint) % (select greatest(64, ceil(count(*) / 65536))::bigint from documents) as shard, md5('43:' || name) as draw from n),
        c as (select source, shard, sum(size)::bigint as words, case when sum(size) > 0 then greatest(1, (sum(size)::bigint + 16) // 32) else 0 end as held from d group by 1, 2),
        s as (select source, sum(words)::bigint as source_size, sum(held)::bigint as own, row_number() over (order by source nulls last) as rk from c group by source),
        w as (select *, 3 * source_size as cap, case (rk - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from s),
        v as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, rk rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, rk rows between current row and unbounded following) as level from w),
        t as (select *, least(cap::double, coalesce(w * max(level) filter (level <= cap / w) over (), cap::double)) as target from v),
        u as (select *, case when source_size > 0 then target * own / source_size::double else 0 end as weight from t),
        q as (select source, row_number() over (order by weight / (2 * k + 1) desc, rk) as place from (select source, rk, weight, unnest(range(0, ceil(weight)::bigint + 2)) as k from u where weight > 0)),
        b as (select source, count(*) as given from q where place <= (select sum(own) from u) group by source),
        cq as (select source, shard, row_number() over (partition by source order by held::double / (2 * k + 1) desc, shard, k) as place from (select source, shard, held, unnest(range(0, 3 * held + 2)) as k from c where held > 0)),
        cb as (select cq.source, cq.shard, count(*) as quota from cq join b on cq.source is not distinct from b.source where place <= given group by 1, 2),
        ct as (select c.source, c.shard, words, held, least(coalesce(quota, 0), 3 * held) as quota from c left join cb on c.source is not distinct from cb.source and c.shard = cb.shard),
        bl as (select source, shard, quota, held, words, unnest(range(0, held)) as k from ct where held > 0),
        br as (select *, row_number() over (partition by source, shard order by md5('44:' || coalesce(source, '') || ':' || (source is null)::int || ':' || shard || ':' || k), k) as nth from bl),
        won as (select source, shard, 32 * k as start, case when k = held - 1 then words else 32 * (k + 1) end as stop from br where nth <= quota % held),
        r as (select row_number() over () as id, d.*, t.source_size, t.target, case when held > 0 then quota // held else 0 end as rounds, coalesce(sum(d.size) over (partition by d.source, d.shard order by draw, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
            from d join t on d.source is not distinct from t.source join ct on d.source is not distinct from ct.source and d.shard = ct.shard),
        m as (select r.id, sum(least(before + size, stop) - greatest(before, start)) as more from r join won on r.source is not distinct from won.source and r.shard = won.shard and start < before + size and stop > before group by 1)
        select doc_id, size, source_size, target, cast(rounds * size + coalesce(more, 0) as bigint) as taken from r left join m using (id)""",
    "op6_substring_dedup": r"""
        with recursive d as (select doc_id as id, text from documents where doc_id is not null and text is not null),
        p as (select id, unnest(ps) as piece, generate_subscripts(ps, 1) - 1 as i from (select id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') as ps from d)),
        w as (select id, i, regexp_replace(piece, '^[\x20\x09-\x0D]+', '') as word, sum(length(piece)) over (partition by id order by i)::bigint as stop from p),
        h as (select id, i, stop - length(word) as start, stop, cast('0x' || substr(md5(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 1, 8) as bigint)::hugeint as v, count(*) over (partition by id) as n from w),
        s as (select id, i, start, stop, n, v * 402653189 + lead(v, 1) over o * 201326611 + lead(v, 2) over o * 469762049 + lead(v, 3) over o * 100663319 + lead(v, 4) over o * 335544323 as s from h window o as (partition by id order by i)),
        y as (select id, i, n, s, s % 4294967291 as y0, (s % 4294967291) * 1664525 % 4294967291 as y1, (s % 4294967291) * (1664525::hugeint * 1664525 % 4294967291) % 4294967291 as y2 from s where i <= n - 5),
        r as (select id, i, n, (min(y0 * 4294967296 + i) over (partition by id order by i rows between current row and 7 following) % 4294967296)::bigint as a,
            (min(y1 * 4294967296 + i) over f % 4294967296)::bigint as k1, (min(y2 * 4294967296 + i) over f % 4294967296)::bigint as k2 from y window f as (partition by id order by i rows between current row and 44 following)),
        an as (select *, coalesce(lead(sx) over (partition by id order by sx), sx) as after from (select distinct id, a as sx, n from r where i <= n - 12)),
        post as (select id, k1 as pos from r where i <= n - 49 union select id, k2 from r where i <= n - 49),
        keyed as (select post.id, pos, s from post join y on y.id = post.id and y.i = pos),
        hot as (select id, pos from keyed where s in (select s from keyed group by s having count(distinct id) > 1)),
        runs as (select r.id, r.i from r left join hot a on a.id = r.id and a.pos = r.k1 left join hot b on b.id = r.id and b.pos = r.k2 where r.i <= r.n - 49 and (a.pos is not null or b.pos is not null)),
        cand as (select id, sx, after from an where sx <= n - 49 and exists (select 1 from runs where runs.id = an.id and runs.i between an.sx - 7 and an.sx + 7)),
        par as (select c.id, c.sx, any_value(f.s) as a, any_value(g.s) as b, list_sort(list(y.s)) as held from cand c join y f on f.id = c.id and f.i = c.sx join y g on g.id = c.id and g.i = c.after join y on y.id = c.id and y.i between c.sx and c.sx + 44 group by c.id, c.sx),
        cl as (select row_number() over (order by rep, a, b) as c, *, list_distinct(held) as sh from (select a, b, held, min({'id': id, 'sx': sx}) as rep, max(id) as last, count(*) as copies from par group by 1, 2, 3)),
        l as (select x.c as a, y.c as b from cl x join cl y on x.a = y.a and x.b = y.b and x.c <> y.c where 100 * len(list_intersect(x.sh, y.sh)) >= 80 * (len(x.sh) + len(y.sh) - len(list_intersect(x.sh, y.sh)))),
        k(a, b) as (select a, b from l union select k.a, l.b from k join l on l.a = k.b),
        m as (select a, min(b) as b from k group by 1),
        ro as (select cl.*, least(c, coalesce(m.b, c)) as root from cl left join m on m.a = cl.c),
        v as (select root, min(rep) as first, max(last) as most, sum(copies)::bigint as total from ro group by 1),
        j as (select par.id, par.sx, v.first, v.total, ro.rep.id <> ro.last as alike from par join ro on ro.a = par.a and ro.b = par.b and ro.held = par.held join v on v.root = ro.root where v.first.id <> v.most),
        z as (select j.id, j.sx, b.start, e.stop, j.sx + 49 - case when alike then 0 else 5 end as upto, j.first.id as cluster, total, j.id = j.first.id and j.sx = j.first.sx as kept
            from j join h b on b.id = j.id and b.i = j.sx join h e on e.id = j.id and e.i = j.sx + 48 - case when alike then 0 else 5 end),
        u as (select *, sum(fresh) over (partition by id, cluster, kept order by sx, upto rows unbounded preceding) as run from (
            select *, case when sx <= max(upto) over (partition by id, cluster, kept order by sx, upto rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from z))
        select id as doc_id, min(start)::bigint as start, max(stop)::bigint as "end", (max(upto) - min(sx))::bigint as n_words, cluster as cluster_id, max(total) as copies, kept from u group by id, cluster, kept, run""",
    "op7_minhash": r"""
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as sh from w),
        n as (select doc_id, sh, len(sh) as n from s),
        t as (select doc_id, n, unnest(sh) as x from n),
        r as (select doc_id, n, x, row_number() over (partition by doc_id order by df, x) as rk from (select *, count(*) over (partition by x) as df from t)),
        p as (select doc_id, x from r where rk <= n - ceil(0.8 * n) + 1),
        c as (select distinct a.doc_id as a, b.doc_id as b from p a join p b on a.x = b.x and a.doc_id < b.doc_id),
        l as (select a, b from (select c.a, c.b, x.n as na, y.n as nb, len(list_intersect(x.sh, y.sh)) as i from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b) where 100 * i >= 80 * (na + nb - i)),
        e as (select a, b from l union select b, a from l),
        k(a, b) as (select a, b from e union select k.a, e.b from k join e on e.a = k.b),
        m as (select a, min(b) as b from k group by 1)
        select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(m.b, n.doc_id)) as component_id, n.doc_id <= coalesce(m.b, n.doc_id) as kept from n left join m on m.a = n.doc_id""",
    "op10_embedding_dedup": """
        with recursive r as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
        f as (select *, list_max(list_transform(e, lambda x: abs(x))) as top from r where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
        v as (select vec_id, label, list_transform(e, lambda x: x / top) as e from f where top > 0),
        ok as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
        l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
        k(a, b) as (select a, b from l union select k.a, l.b from k join l on l.a = k.b),
        m as (select a, min(b) as b from k group by 1), d as (select a, count(*) as n from l group by 1)
        select vec_id, coalesce(d.n, 0) as n_links, least(vec_id, coalesce(m.b, vec_id)) as component_id, vec_id <= coalesce(m.b, vec_id) as kept
        from embeddings left join m on m.a = vec_id left join d on d.a = vec_id""",
    "op11_ranked_search": r"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
        k as (select r, doc_id, len(ts) as n, ts from d where len(ts) > 0),
        c as (select count(*) as docs, sum(n)::bigint as total from k),
        m as (select r, doc_id, 10 + (90 * n * docs) // total as m from k, c),
        q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
        p as (select r, t, count(*) as tf from (select r, unnest(ts) as t from k) where t in (select t from q) group by 1, 2),
        w as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select t, count(*) as df from p group by 1), c),
        s as (select q.item_id, m.r, m.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::bigint as score from q join w using (t) join p using (t) join m using (r) group by 1, 2, 3)
        select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10""",
    "op12_resample": r"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
        dw as (select r, unnest(ws) as w from d),
        bw as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
        v as (select w, hex(encode(w)) as h from (select w from dw union select w from bw)),
        z as (select w, xor(list_reduce(range(0, len(h) // 2), lambda c, i: list_reduce(range(0, 8), lambda a, j: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end,
            xor(c, ('0x' || substr(h, 2 * i + 1, 2))::bigint)), 4294967295::bigint), 4294967295) % 10000 as b from v),
        s as (select b, count(*) as s from dw join z using (w) group by 1), t as (select b, count(*) as t from bw join z using (w) group by 1),
        ss as (select coalesce(sum(s), 0)::double as ss from s), tt as (select coalesce(sum(t), 0)::double as tt from t),
        g as (select s.b, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::bigint as g from s left join t using (b), ss, tt),
        x as (select r, sum(g)::bigint as g, count(*) as n from dw join z using (w) join g using (b) group by 1),
        y as (select d.doc_id, coalesce(n, 0) as n_features, coalesce((g - (g % n + n) % n) // n, 0) as weight, ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint as h from d left join x using (r)),
        o as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from y),
        f as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as rank, (select count(*) from o where n_features >= 20) as n from o)
        select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from f""",
}
