"""The same results in DuckDB SQL, for checking queries.py."""

from __future__ import annotations

from offerloom.functions.text import CATEGORY_RULES
from offerloom.plans.queries import LATER, NOW, PAGE_SELECTORS, REVIEWED, SITE
from offerloom.plans.views import AS_OF, VIEWS
from offerloom.schema import CATEGORIES, CATEGORY_LABELS

_EXPIRES = "try_strptime(case when contains(valid_until, 'T') then valid_until else valid_until || 'T23:59:59.999Z' end, '%Y-%m-%dT%H:%M:%S.%gZ')"
_ACTIVE = f"coalesce({_EXPIRES} >= timestamp '{AS_OF}', true)"
_LABEL = "case category " + " ".join(f"when '{k}' then '{v}'" for k, v in CATEGORY_LABELS.items()) + " else 'Other' end"
_TEXT = f"lower(concat_ws(' ', nullif(title, ''), nullif(bank_name, ''), nullif(bank_short_name, ''), nullif(card_name, ''), nullif(merchant, ''), nullif(description, ''), nullif(category, ''), {_LABEL}))"
_KEY = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
_CLASS = lambda c: "case " + " ".join(f"when regexp_matches({c}, '(?i)\\b(?:{p})\\b') then '{k}'" for k, p in CATEGORY_RULES) + " else 'other' end"
_PAGE = lambda c: f"regexp_replace({c}, '^([a-z]+://[^/?#]+)([^?#]*?)/*(\\?[^#]*)?(#.*)?$', '\\1\\2/\\3')"
_SLUG = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"
_NOFRAG = lambda c: f"regexp_replace({c}, '#.*$', '')"

DERIVED = {
    "offers": "select *, source_url as terms_link from offer_raw",
    "served": """
        select o.id, b.bank_id, b.name as bank_name, b.short_name as bank_short_name, c.card_id, c.name as card_name, o.title, o.category, o.description, o.merchant, o.location, o.valid_from, o.valid_until,
               o.terms_link as terms, o.source_url, o.last_reviewed_at as first_seen_at, o.last_reviewed_at as last_seen_at, o.last_reviewed_at as last_checked_at, o.status, sha1(o.id || '|' || o.last_reviewed_at) as raw_source_hash, o.seq
        from offers o join card c on o.card_id = c.card_id join bank b on c.bank_id = b.bank_id""",
    "active": f"select * from served where status = 'active' and {_ACTIVE}",
    "firsts": "select * from offers qualify row_number() over (partition by id order by seq) = 1",
    "old_batch": "select * from firsts where seq % 10 < 8",
    "new_batch": "select * replace (case when seq % 10 = 5 then title || ' v2' else title end as title) from firsts where seq % 10 >= 4",
    "gate_rows": """
        select 'nation_' || (doc_id % 25) as bank_id, 'https://x.example/' || doc_id || '/' as url_key, doc_id as pos, doc_id % 10 <> 0 as fetched, doc_id % 10 <> 1 as has_content, sha1(text) as hash, doc_id % 7 <> 0 as extracts,
               case when doc_id % 10 in (2, 3, 0) then sha1(text) when doc_id % 10 = 4 then sha1(text || 'old') end as old_hash,
               case when doc_id % 10 in (2, 4, 0, 5) then 1 + cast(doc_id % 10 = 2 as int) else 0 end as prior from documents""",
    "gated": """
        select *, case when not fetched then 'fetch-failed' when not has_content then 'no-content' when coalesce(old_hash = hash and prior > 0, false) then 'unchanged' else 'changed' end as gate from gate_rows""",
    "budgeted": "select *, coalesce(sum(cast(gate = 'changed' and extracts as int)) over (partition by bank_id order by pos rows between unbounded preceding and 1 preceding), 0) as before from gated",
    "decided": "select *, case when gate <> 'changed' then gate when before >= 12 then 'over-budget' when extracts then 'extracted' else 'extract-failed' end as decision from budgeted",
    "hash_gate": """
        select bank_id, url_key, pos, decision, case when decision = 'extracted' then 0 else prior end as reused,
               case when decision in ('unchanged', 'extracted') then hash when prior > 0 then old_hash end as next_hash from decided""",
    "reconciled": """
        select p.user_id, p.preset_id, list_filter(p.bank_ids, lambda b: list_contains(e.every, b)) as bank_ids, p.categories, p.bank_ids as had, p.card_id as card, c.bank_id as card_bank
        from preset p cross join (select list(bank_id) as every from bank) e left join card c on p.card_id = c.card_id""",
    "repaired": """
        select *, case when card_bank is not null and (len(had) = 0 or list_contains(bank_ids, card_bank)) then card end as card_id from reconciled""",
    "preset_fresh": f"select * from preset where coalesce(last_used_at, created_at) >= timestamp '{AS_OF}' - interval 60 day",
    "visits": "select event_id, client_key, url, coalesce(ts >= lag(ts) over (partition by client_key order by ts, event_id) + interval 30 minute, false) as is_return from request_log",
    "feed_a_rows": "select doc_id // 100 as feed_id, doc_id as k, cast(row_number() over (partition by doc_id // 100 order by doc_id) - 1 as int) as pos from documents",
    "hrefs": "select page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages",
    "targets": f"select page_id, {_PAGE('url')} as page_key, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) as site, href from hrefs where href like '/%'",
    "semantic_rows": f"""
        select *, coalesce(nullif({_KEY('merchant')}, ''), {_KEY('title')}) as a, {_KEY('description')} as d,
               cast(coalesce(valid_until, '') <> '' as int) + cast(coalesce(valid_from, '') <> '' as int) + cast(coalesce(location, '') <> '' as int) + cast(coalesce(terms_link, '') <> '' as int) as s from firsts""",
    "semantic_lists": "select card_id, a, d, list(struct_pack(seq := seq, s := s, n := len(description)) order by seq) as g from semantic_rows group by card_id, a, d",
    "semantic": """
        select card_id, a, d, g[1].seq as place, list_reduce(g, lambda x, y: case when y.s + cast(y.n > x.n as int) > x.s + cast(x.n > y.n as int) then y else x end).seq as won from semantic_lists""",
    "bank_counts": "select c.bank_id, cast(coalesce(sum(n), 0) as bigint) as offers from card c left join (select card_id, count(*) as n from offers group by card_id) o on o.card_id = c.card_id group by c.bank_id",
    "changes": """
        select *, case when op = 'save' and k % 2 = 1 then k + 100000000 else k end as preset_id, epoch_us(moment) as t, lower(trim(name)) as nk from (
          select user_id, case when preset_id % 96 = 0 then 'clear' else ['save', 'delete', 'touch', 'save', 'touch', 'save', 'touch'][1 + preset_id % 7] end as op, preset_id as k, upper(name) as name,
                 cast(cast(created_at as date) + cast(preset_id % 50 as int) as timestamp) as moment from preset)""",
    "numbered_changes": "select *, row_number() over (partition by user_id order by t, op, preset_id) as i from changes",
    "first_lists": """
        select user_id, list_sort(list(struct_pack(neg := -epoch_us(cast(coalesce(last_used_at, created_at) as timestamp)), id := preset_id, name := name, nk := lower(trim(name)))))[1:10] as l from preset group by user_id""",
}


def _with(body: str, recursive: bool = False) -> str:
    """A statement with the relations that it names, in order of their dependence."""
    every = {**VIEWS, **DERIVED}
    need: list[str] = []

    def add(sql: str) -> None:
        import re

        for name in every:
            if name not in need and re.search(rf"(?:from|join|in \(select \w+ from)\s+{name}\b", sql):
                add(every[name])
                if name not in need:
                    need.append(name)

    add(body)
    head = ", ".join(f"{n} as ({every[n]})" for n in need)
    if body.lstrip().startswith("with "):
        return f"with {'recursive ' if recursive else ''}{head + ', ' if head else ''}{body.lstrip()[5:]}"
    return f"with {head} {body}" if head else body


_BANKS_EVEN = "(select bank_id from bank where seq % 2 = 0)"
_BATCH_BANK = "(select o.*, c.bank_id from {} o join card c on o.card_id = c.card_id)"

BODIES = {
    "catalog_violations": """
        with v as (select seq, case when seq % 97 = 0 then 'bogus' else category end as category, case when seq % 89 <> 0 then title end as title from offers)
        select seq, 'missing title' as violation from v where title is null union all select seq, 'unknown category' from v where category = 'bogus'""",
    "scrape_violations": "select seq, 'missing category' as violation from scrape_raw where seq % 11 = 0 union all select seq, 'missing source_url' from scrape_raw where seq % 13 = 0",
    "catalog_offers": "select * from served",
    "active_offers": "select id, bank_id, category, valid_until, seq from active",
    "expiring_soon": f"select id, valid_until, seq from served where {_EXPIRES} between timestamp '{AS_OF}' and timestamp '{AS_OF}' + interval 14 day",
    "filter_facets": "select id, bank_id, category, seq from active where bank_id in ('nation_1', 'nation_2', 'nation_3') and category in ('dining', 'fuel')",
    "search_text": f"select id, seq from active where contains({_TEXT}, 'brand#1')",
    "offer_lookup": """
        select 'offer' as kind, id, title from (select * from offers where id = 'o1-1' order by seq limit 1) union all select 'bank', bank_id, name from bank where bank_id = 'nation_3'
        union all select 'card', card_id, name from card where bank_id = 'nation_3'""",
    "filter_locked": "select id, bank_id, category, seq from active where bank_id = 'nation_4' and category = 'fuel'",
    "offer_json_export": f"""
        select id, merchant as seller, valid_from, sha1('{{"@type":"Offer","name":' || to_json(title) || ',"description":' || to_json(description) || ',"category":' || to_json({_LABEL}) || ',"offeredBy":{{"@type":"BankOrCreditUnion","name":' || to_json(bank_name) || '}}'
          || coalesce(',"validFrom":' || to_json(valid_from), '') || coalesce(',"validThrough":' || to_json(valid_until), '') || coalesce(',"seller":{{"@type":"Organization","name":' || to_json(merchant) || '}}', '') || ',"dateModified":' || to_json(last_checked_at) || '}}') as json_hash from active""",
    "scan_violations": """
        with r as (select o.id, o.seq, case when o.seq % 50 = 2 then 'none' else o.card_id end as card_id, case o.seq % 50 when 0 then 'nowhere' when 1 then 'nation_0' else c.bank_id end as bank_id from offers o join card c on o.card_id = c.card_id)
        select * from (select r.id, r.seq, case when b.bank_id is null then 'missing bank' when c.card_id is null then 'missing card' when c.bank_id <> r.bank_id then 'bank and card differ' end as violation
        from r left join bank b on r.bank_id = b.bank_id left join card c on c.card_id = r.card_id) where violation is not null""",
    "sync_scanned": f"""
        with n as (select * from new_batch)
        select id, title, 0 as part, seq from old_batch where id not in (select id from n) and {_NOFRAG('source_url')} not in (select {_NOFRAG('source_url')} from n) union all select id, title, 1, seq from n""",
    "merge_lifecycle": f"""
        select coalesce(o.id, n.id) as id, coalesce(n.title, o.title) as title,
               case when n.id is null then case when o.status = 'expired' then 'expired' else 'inactive' end when coalesce((select {_EXPIRES} < timestamp '{AS_OF}' from (select n.valid_until)), false) then 'expired' else 'active' end as status,
               case when o.id is null then '{NOW}' else o.last_reviewed_at end as first_seen_at, case when n.id is null then o.last_reviewed_at else '{NOW}' end as last_seen_at, '{NOW}' as last_checked_at,
               case when n.id is null then o.valid_until else n.valid_until end as valid_until, cast(o.id is null as int) as part, coalesce(o.seq, n.seq) as seq
        from old_batch o full outer join new_batch n on o.id = n.id""",
    "refresh_runs": f"""
        with o as (select f.*, c.bank_id, case when coalesce((select {_EXPIRES} < timestamp '{AS_OF}' from (select f.valid_until)), false) then 'expired' else 'active' end as was from old_batch f join card c on f.card_id = c.card_id),
        n as (select f.*, c.bank_id from new_batch f join card c on f.card_id = c.card_id), again as (select distinct bank_id from n)
        select coalesce(n.id, o.id) as id, coalesce(n.title, o.title) as title,
               case when n.id is not null then case when coalesce((select {_EXPIRES} < timestamp '{LATER[:10]} {LATER[11:19]}' from (select n.valid_until)), false) then 'expired' else 'active' end
                    when o.bank_id in (select bank_id from again) and o.was <> 'expired' then 'inactive' else o.was end as status,
               case when o.id is null then '{LATER}' else '{NOW}' end as first_seen_at, case when n.id is null then '{NOW}' else '{LATER}' end as last_seen_at,
               case when coalesce(n.bank_id, o.bank_id) in (select bank_id from again) then '{LATER}' else '{NOW}' end as last_checked_at,
               coalesce(n.valid_until, o.valid_until) as valid_until, coalesce(o.seq, n.seq) as seq
        from o full outer join n on o.id = n.id""",
    "reconcile_orphans": f"""
        with r as (select id, case when seq % 100 = 0 then 'unknown' else card_id end as card_id, seq from offers)
        select * from r where card_id not in (select card_id from card where bank_id not in {_BANKS_EVEN})""",
    "hash_gate": "select * from hash_gate",
    "extraction_budget": "select bank_id, decision, count(*) as urls, cast(sum(reused) as bigint) as reused from hash_gate group by bank_id, decision",
    "cards_in_scope": f"select card_id, bank_id from card where bank_id in {_BANKS_EVEN}",
    "match_saved_filters": f"""
        with f as (select preset_id, list_sort(list_distinct(bank_ids)) as b, list_sort(list_distinct(categories)) as c, preset_id % 5 = 0 as s from preset),
        k as (select distinct b, c, s from f), t as (select bank_id, category, {_TEXT} as text from active),
        n as (select k.b, k.c, k.s, count(t.bank_id) as n from k left join t on list_contains(k.b, t.bank_id) and list_contains(k.c, t.category) and (not k.s or contains(t.text, 'brand#2')) group by all)
        select f.preset_id as filter_id, n.n as offers from f join n on f.b = n.b and f.c = n.c and f.s = n.s""",
    "count_by_bank": "select b.bank_id, count(a.id) as offers from bank b left join active a on a.bank_id = b.bank_id group by b.bank_id",
    "count_by_category": "select c.category, count(a.id) as offers from (select unnest(" + str(list(CATEGORIES)) + ") as category) c left join active a on a.category = c.category group by c.category",
    "catalog_totals": "select count(*) filter (where category = 'dining') as matching, count(*) as total, cast(count(*) // 100 * 100 as bigint) as rounded from active",
    "bank_offer_count": "select * from bank_counts",
    "collapse_gate": f"""
        with r as (select c.bank_id, o.*, {_KEY('o.description')} as d, coalesce(nullif({_KEY('o.merchant')}, ''), {_KEY('o.title')}) as a from new_batch o join card c on o.card_id = c.card_id),
        f as (select bank_id, case when bank_id like '%1' then 1 else count(distinct (card_id, a, d)) end as fresh from r group by bank_id)
        select b.bank_id, b.offers as stored, coalesce(f.fresh, 0) as fresh, b.offers >= 10 and coalesce(f.fresh, 0) <= 3 and b.bank_id <> 'nation_11' as rejected from bank_counts b left join f on f.bank_id = b.bank_id""",
    "refresh_summary": """
        select ['updated', 'unchanged', 'fetch-failed', 'sanity-rejected'][1 + seq % 4] as status, count(*) as banks, count(*) filter (where seq % 4 >= 2) as failed, cast(sum(seq * 10) as bigint) as tokens_in, cast(sum(seq) as bigint) as tokens_out,
               cast(coalesce(sum(seq) filter (where seq % 4 = 0), 0) as bigint) as written from bank group by 1""",
    "bank_status": """
        with f as (select bank_id || '-' || card_id as bank_id, seq % 7 <> 0 as enabled, (seq // 2) % 2 = 1 as crawl, seq % 5 <> 0 as ex, (seq // 4) % 2 = 1 as disc, seq % 3 as act, (seq // 8) % 2 = 1 as rej, seq % 4 as src, seq % 6 = 1 as thin, seq % 11 = 0 as same, (seq // 16) % 2 = 1 as mapper, (seq // 32) % 2 = 1 as over_b from card)
        select bank_id, case when not enabled then 'disabled'
          when crawl then case when not ex then 'deferred' when not disc then 'fetch-failed' when act = 0 then 'extract-failed' when rej then 'sanity-rejected' else 'updated' end
          else case when src = 0 then 'fetch-failed' when thin then 'skipped-empty' when same then 'unchanged' when not mapper and (not ex or over_b) then 'deferred' when act = 0 then 'extract-failed' when rej then 'sanity-rejected' else 'updated' end end as status from f""",
    "expire_lapsed": f"""
        select * from (select count(*) filter (where not {_ACTIVE}) as stored_dropped, count(*) filter (where {_ACTIVE}) as stored_kept from old_batch), (select count(*) filter (where not {_ACTIVE}) as staging_dropped, count(*) filter (where {_ACTIVE}) as staging_kept from new_batch)""",
    "refresh_sweep": f"select id, seq from offers where card_id not in (select card_id from card where bank_id not in {_BANKS_EVEN}) and {_ACTIVE}",
    "bank_content_hash": """
        select 'bank_' || (page_id // 100) as bank_id, sha1(concat_ws('|', string_agg(sha1(html), '|' order by page_id), string_agg(url, '|' order by url) filter (where page_id % 3 = 0))) as hash from pages group by 1""",
    "dedupe_first": "select id, title, seq from firsts",
    "dedupe_last": "select id, max_by(title, seq) as title, min(seq) as seq from offers group by id",
    "dedupe_semantic": "select r.id, r.card_id, r.description, s.place as seq from semantic s join semantic_rows r on r.seq = s.won where s.a <> '' or s.d <> '' union all select id, card_id, description, seq from semantic_rows where a = '' and d = ''",
    "page_slice": "select id, seq from active order by last_seen_at desc, first_seen_at desc, seq limit 24 offset 48",
    "page_slice_late": f"""
        with p as (select least(40, greatest(1, cast(ceil(count(*) / 24.0) as int))) as page from active),
        o as (select id, seq, row_number() over (order by {_EXPIRES.replace('T23:59:59.999Z', 'T00:00:00.000Z')} nulls last, seq) as k from active)
        select id, seq from o, p where k > (page - 1) * 24 and k <= page * 24""",
    "page_meta": """
        with c as (select count(*) as n from active), p as (select n, greatest(1, cast(ceil(n / 24.0) as int)) as pages from c)
        select n as total_items, pages as total_pages, case when n = 0 then 1 else pages end as page, 24 as page_size, case when n = 0 then 0 else (pages - 1) * 24 + 1 end as start_index, n as end_index from p""",
    "import_bank": f"""
        with st as (select * from {_BATCH_BANK.format('old_batch')} ), nb as (select * from {_BATCH_BANK.format('new_batch')} where bank_id in {_BANKS_EVEN}),
        hit as (select distinct bank_id from nb),
        staged as (select id, title, source_url, 0 as part, seq from st where bank_id not in (select bank_id from hit) union all select id, title, source_url, 1, seq from nb),
        kept as (select * from old_batch where card_id not in (select card_id from card where bank_id in (select bank_id from hit)) and id not in (select id from staged) and {_NOFRAG('source_url')} not in (select {_NOFRAG('source_url')} from staged))
        select 'stored' as kind, id, title, 0 as part, seq from kept union all select 'stored', id, title, 1, seq from staged union all select 'staged', id, title, part, seq from staged""",
    "remove_bank": """
        with g as (select bank_id from bank where seq < 5), gc as (select card_id from card where bank_id in (select bank_id from g))
        select 'stored' as kind, count(*) as rows from old_batch where card_id not in (select card_id from gc)
        union all select 'staging', count(*) from new_batch o join card c on o.card_id = c.card_id where c.bank_id not in (select bank_id from g)
        union all select 'banks', count(*) from bank where seq >= 5 union all select 'cards', count(*) from card where bank_id not in (select bank_id from g)""",
    "url_feed": f"""
        select '{SITE}' as url, 'daily' as change_frequency, 1.0::double as priority, null::varchar as last_modified union all select '{SITE}/categories', 'weekly', 0.8, null
        union all select '{SITE}/banks/' || bank_id, 'daily', 0.8, null from bank union all select '{SITE}/categories/' || c, 'daily', 0.7, null from (select unnest({list(CATEGORIES)}) as c)
        union all select '{SITE}/offers/' || id, 'weekly', 0.6, last_checked_at from served where status = 'active'""",
    "classify_text": f"select seq, {_CLASS('offer_about')} as category from scrape_raw",
    "normalize_scrapes": f"""
        with r as (select *, ['boc', 'cargills-bank', 'dfcc', 'ndb', 'ntb', 'pan-asia-bank', 'peoples-bank', 'sampath', 'seylan', 'union-bank'][1 + seq % 10] as bank,
                          ['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'] as months,
                          regexp_replace(cast(offer_amount_percent as varchar), '\\.0$', '') as percent, {_CLASS('offer_about')} as asked, split_part(offer_about, ' - ', 1) as lead, offer_about as t
                   from scrape_raw where (expiry_date is null or expiry_date >= '{REVIEWED[:10]}') and source_url is not null),
        m as (select *, regexp_matches(t, '(?i)\\binstall?ment') as plan, regexp_matches(t, '(?i)\\bcash\\s*back\\b') as cash,
                     case when bank = 'ntb' then null when bank in ('peoples-bank', 'union-bank') and not regexp_matches(t, '(?i)\\s-\\s+(up to\\s+)?\\d+(\\.\\d+)?%') then t
                          when bank = 'sampath' and not regexp_matches(t, '(?i)^.+?\\s+-\\s+(up to\\b|\\d)') then null else lead end as merchant from r),
        c as (select *, case
                when bank = 'cargills-bank' and category = 'Other' and plan or bank in ('seylan', 'union-bank') and plan then 'installment' when bank = 'seylan' and cash then 'cashback'
                when category = 'Dining' and bank <> 'pan-asia-bank' then 'dining' when category = 'Travel' and bank not in ('boc', 'pan-asia-bank') then 'travel'
                when category = 'Other' and bank in ('cargills-bank', 'union-bank') then 'other' else asked end as kind,
                case when expiry_date is null then '' else '-' || months[cast(split_part(expiry_date, '-', 2) as int)] || '-' || split_part(expiry_date, '-', 1) end as suffix,
                case when regexp_matches(t, '(?i)\\bup to\\b') then 'Up to ' else '' end || percent || '% off' as deal from m),
        i as (select *, case bank when 'boc' then cast(seq as varchar) when 'dfcc' then 'product' when 'seylan' then 'product' when 'peoples-bank' then 'product'
                when 'ndb' then {_SLUG('merchant')}[1:48] when 'sampath' then {_SLUG("coalesce(merchant, t)")}[1:48] else {_SLUG('merchant')} end as subject from c)
        select case when bank = 'ntb' then 'ntb-' || {_SLUG('t')}[1:48] || '-' || sha1(concat_ws('|', source_url, t, coalesce(expiry_date, 'open')))[1:8] else bank || '-' || subject || suffix end as id, bank as bank_id,
               case bank when 'cargills-bank' then 'cargills-bank-mastercard-credit-cards' when 'ntb' then 'ntb-mastercard-credit-cards' else bank || '-credit-cards' end as card_id,
               case when bank in ('ndb', 'ntb', 'sampath') then t
                    when bank in ('boc', 'cargills-bank', 'dfcc', 'seylan', 'union-bank') and kind = 'installment' then merchant || ' installment plans'
                    when bank in ('seylan', 'union-bank') and kind = 'cashback' and percent is not null then percent || case when contains(t, 'fuel') then '% cashback on fuel transactions' else '% cashback with ' || merchant end
                    when bank = 'cargills-bank' and plan and deal is not null then deal || ' and installment plans at ' || merchant
                    when deal is not null then deal || ' at ' || merchant when bank = 'pan-asia-bank' and plan then merchant || ' installment plans' else merchant end as title,
               kind as category, t as description, merchant, expiry_date as valid_until, source_url as terms_link, source_url, seq from i""",
    "page_strip_hash": """
        with s as (select page_id, url, regexp_replace(html, '(?s)<!--.*?-->|<head>.*?</head>|<(script|style|noscript|nav|header|footer|svg|iframe|form)\\b.*?</(script|style|noscript|nav|header|footer|svg|iframe|form)>', '', 'g') as t from pages),
        d as (select page_id, url, replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as t from s),
        n as (select page_id, url, trim(regexp_replace(strip_accents(translate(replace(t, '…', '...'), '‘’“”‐‑‒–—―', '''''""------')), '\\s+', ' ', 'g')) as t from d)
        select page_id, url, cast(length(t) as int) as n_chars, sha1(t) as hash from n""",
    "stable_ids": "select seq, card_id || '-' || sha1(card_id || '|' || title || '|' || source_url)[1:12] as stable_id from offers",
    "url_keys": f"select distinct source_url, {_PAGE('source_url')} as page_key, {_NOFRAG('source_url')} as asset_key from offers",
    "extract_expiry": """
        select doc_id, case doc_id % 3 when 0 then '2026-' || lpad(cast(doc_id % 12 + 1 as varchar), 2, '0') || '-07' when 1 then '2027-03-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') end as valid_until from documents""",
    "feed_a": f"""
        select 'nation_1-' || k as id, 'nation_1' as bank_id, case when k % 3 = 0 then 'n1-debit' else 'n1-credit' end as card_id, '20% off at restaurant ' || (k % 40) as title, 'dining' as category, '20% off at restaurant ' || (k % 40) as description, 'Shop ' || (k % 9) as merchant,
               '2026-01-05' as valid_from, case when k % 2 = 0 then '2026-09-30' end as valid_until, '{SITE}/search/' || k as terms_link, '{SITE}/search/' || k as source_url, feed_id, pos from feed_a_rows""",
    "feed_b": f"""
        with r as (select *, k % 300 as oid, feed_id * 1000000 + pos as seq from feed_a_rows where k % 7 <> 0),
        d as (select *, case k % 4 when 0 then '0% interest plan' when 1 then '10% Cash Back' else '15% off' end as disc, case when k % 2 = 0 then 'Hotels' else 'fashion' end as tab from r),
        f as (select oid, min(seq) as seq, max_by(struct_pack(k := k, disc := disc, tab := tab), seq) as v from d group by oid)
        select 'nation_2-' || oid as id, 'nation_2' as bank_id, 'n2-credit' as card_id, v.disc || ' at Shop ' || (v.k % 40) as title, case v.k % 4 when 0 then 'installment' when 1 then 'cashback' else case when v.tab = 'Hotels' then 'travel' else 'other' end end as category,
               'Deal & more ' || v.k as description, 'Shop ' || (v.k % 40) as merchant, null::varchar as location, null::varchar as valid_from, case when v.k % 5 <> 0 then '2026-09-21' end as valid_until, '{SITE}' as terms_link, '{SITE}?firstTab=' || v.tab as source_url, seq // 1000000 as feed_id, cast(seq % 1000000 as int) as pos from f""",
    "feed_registry": """
        with d as (select *, k % 300 as oid, case k % 4 when 0 then '0% interest plan' when 1 then '10% Cash Back' else '15% off' end as disc from feed_a_rows where k % 7 <> 0 and feed_id % 3 = 1)
        select 'nation_1' as bank_id, 'nation_1-' || k as id, '20% off at restaurant ' || (k % 40) as title from feed_a_rows where feed_id % 3 = 0
        union all select 'nation_2', 'nation_2-' || oid, max_by(disc || ' at Shop ' || (k % 40), feed_id * 1000000 + pos) from d group by oid
        union all select distinct 'nation_3', cast(feed_id as varchar), null from feed_a_rows where feed_id % 3 = 2""",
    "page_extract": f"""
        with r as (select trim(url) as title, {_PAGE('url')} as k, url from pages)
        select distinct 'nation_1-' || sha1('nation_1|' || title || '|' || url)[1:12] as id, title, case when contains(url, '/en/') then 'travel' else 'other' end as category, url as source_url from r""",
    "dimension_violations": """
        select bank_id as key, 'missing short_name' as violation from bank where seq % 6 = 0 union all select card_id, 'unknown bank' from card where seq % 9 = 0""",
    "catalog_orphans": """
        with r as (select id, seq, case when seq % 100 = 0 then 'unknown' else card_id end as card_id from offers)
        select r.id, r.card_id, r.seq, case when c.card_id is null then 'missing card' else 'missing bank' end as violation from r left join card c on r.card_id = c.card_id where c.card_id is null or c.bank_id = 'nation_3'""",
    "feed_envelope": """
        with n as (select feed_id, count(*) as n from feed_a_rows group by feed_id)
        select feed_id, case feed_id % 6 when 3 then 0 when 4 then n when 5 then n end as rows, cast(case feed_id % 6 when 2 then 3 when 3 then 4 when 4 then cast('9' || n as int) when 5 then n end as double) as total,
               case feed_id % 6 when 0 then 'empty' when 1 then 'not json' when 2 then 'no data' when 3 then 'inconsistent' when 4 then 'truncated' end as problem from n""",
    "conform_extracted": """
        with r as (select doc_id as k, 'Deal ' || (doc_id % 90) as title, 'https://x.example/' || (doc_id % 30) as url, case when doc_id % 2 = 0 then 'dining' else 'other' end as category, lang from documents),
        i as (select *, 'nation_1-' || sha1('nation_1|' || title || '|' || url)[1:12] as id, k as seq from r)
        select id, any_value(title) as title, max_by(category, seq) as category, max_by(lang, seq) as description, null::varchar as merchant, null::varchar as valid_from, '2026-12-31' as valid_until, any_value(url) as terms_link, any_value(url) as source_url, min(seq) as feed_id, 0 as pos from i group by id""",
    "candidate_cap": """
        with r as (select page_id, url, unnest(range(0, least(120, page_id % 140 + 1))) as i from pages), n as (select *, page_id || '-' || i as k from r),
        l as (select page_id, i, 'Weekly deal ' || k as title, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || '/promo/' || k as link from n)
        select 'nation_1-' || sha1('nation_1|' || title || '|' || link)[1:12] as id, title, link as source_url, page_id * 1048576 + i as seq from l""",
    "refresh_pages": f"""
        with l as (select page_id, 'Weekly deal ' || page_id || '-0' as title, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || '/promo/' || page_id || '-0' as link from pages),
        f as (select page_id, title, 'nation_1-' || sha1('nation_1|' || title || '|' || link)[1:12] as id from l)
        select id, title, case when '2026-05-07' < '{REVIEWED[:10]}' then 'expired' else 'active' end as status, case when page_id % 2 = 0 then 't0' else '{REVIEWED}' end as first_seen_at, '{REVIEWED}' as last_seen_at, '2026-05-07' as valid_until from f
        union all select 'gone-' || page_id, title, case when page_id % 10 = 0 then 'expired' else 'inactive' end, 't0', 't0', null from f where page_id % 5 = 0""",
    "page_assets": """
        with s as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) as site from pages),
        d as (select distinct site || '/f/' || page_id || '.PDF/?v=1' as url from s where page_id % 10 = 0),
        a as (select distinct site || '/f/' || page_id || '.PDF?v=1' as url, 'pdf' as type from s union all select distinct 'https://cdn.example/' || (page_id % 50) || '.pdf', 'pdf' from s union all select distinct site || '/i/' || page_id || '.png', 'image' from s)
        select url, 'static_html' as type from d union all select url, type from a where url not in (select url from d)""",
    "content_images": """
        with r as (select page_id, case when page_id % 7 = 0 then 'data:' else '' end || regexp_extract(url, '^([^?#]*)', 1) || ['.png', '.JPG?x=1', '.svg', '.webp'][1 + page_id % 4] as image, length(html) * 3 as size from pages)
        select page_id, image from r where not starts_with(image, 'data:') and page_id % 4 <> 2 and size >= 10240""",
    "append_missing": "select id, title, seq from old_batch union all select id, title, seq from new_batch where id not in (select id from old_batch)",
    "registry_sources": "select bank_id, unnest([website_url, website_url || '/feed.json']) as url, unnest(['static_html', 'json_feed']) as type from bank where seq % 4 <> 0",
    "display_labels": f"select seq, coalesce(strftime(try_cast(valid_until[1:10] as date), '%b %-d, %Y'), 'Not specified') as until, {_LABEL} as label from offers",
    "page_links": f"select distinct page_key, {_PAGE('site || href')} as url from targets where regexp_matches(href, '^/[a-zA-Z]')",
    "page_candidates": """
        with r as (select page_id, 'Weekly deal ' || page_id as title, 'Weekly deal ' || page_id || ' Save 10% at our hotel until 2026-05-07. more' as text, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || '/promo/' || page_id as link from pages)
        select 'nation_1-' || sha1('nation_1|' || title || '|' || link)[1:12] as id, 'nation_1' as bank_id, title, 'travel' as category, text as description, '2026-05-07' as valid_until, link as source_url, null::varchar as image_url, sha1(text) as raw_source_hash, page_id * 1048576 as seq from r""",
    "crawl_discover": f"""
        with s as (select distinct page_id % 25 as n, 'nation_' || (page_id % 25) as bank_id, {_PAGE('url')} as page_key from pages),
        t as (select s.n, s.bank_id, {_PAGE('site || href')} as url, href from s join targets x on s.page_key = x.page_key),
        d as (select distinct bank_id, url from t where n % 3 = 0 and href like '/th%' or n % 3 = 1 and href = '/the'), b as (select distinct n, bank_id from s)
        select bank_id, url, null::varchar as error from d union all
        select bank_id, null, case n % 3 when 0 then 'no detail links matched ^/th' when 1 then 'no detail links matched selector a[href="/the"]'
          else case when bank_id in (select bank_id from t where href like '/th%') then 'no detail links matched ^/' else 'no links matched hop ^/th' end end from b where bank_id not in (select bank_id from d)""",
    "crawl_queue": """
        with s as (select page_id from pages where page_id % 50 < 25),
        q as (select page_id % 25 as n, page_id, page_id as d, 0 as level from s union all select page_id % 25, page_id, page_id + 25, 1 from s),
        v as (select n, d from q qualify row_number() over (partition by n order by level, page_id desc) <= 8)
        select 'nation_' || n as bank_id, 'https://site.example/d/' || d || '/' as url, null::varchar as error from v where d in (select page_id from pages)
        union all select 'nation_' || n, null, 'no detail links matched selector nav ~ .pager > span:first-child a' from (select distinct n from v) where n not in (select n from v where d in (select page_id from pages))""",
    "page_select": f"""
        with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages), h as (select page_id, l[i] as href, i, len(l) as n from l, unnest(range(1, len(l) + 1)) as t(i))
        """
    + " union all ".join(
        f"select distinct page_id, '{css.replace(chr(39), chr(39) * 2)}' as css, href from h where {where}"
        for css, where in zip(PAGE_SELECTORS, ("i % 2 = 1", "i = 2", "i < n and href like '/th%'", "i = n - 1 and i > 1 or n = 1", "href like '%.' or href like '%en%'"))
    ),
    "presets_clean": f"select user_id, preset_id, bank_ids, list_filter(categories, lambda c: list_contains({list(CATEGORIES)}, c)) as categories from preset_fresh",
    "presets_recent": "select user_id, preset_id, rank from (select *, row_number() over (partition by user_id order by coalesce(last_used_at, created_at) desc, preset_id) as rank from preset_fresh) where rank <= 3",
    # one change after another: what is left at its time, the latest ten, then the change
    "preset_upsert": """
        with w as (select user_id, cast(0 as bigint) as i, l from first_lists
          union all select user_id, i, case op
              when 'save' then list_sort(list_append(list_filter(r, lambda p: p.id is distinct from x.id), struct_pack(neg := -t, id := coalesce(x.id, preset_id), name := trim(name), nk := nk)))[1:10]
              when 'delete' then list_filter(r, lambda p: p.id <> preset_id)
              when 'touch' then list_sort(list_transform(r, lambda p: case when p.id = preset_id then struct_pack(neg := -t, id := p.id, name := p.name, nk := p.nk) else p end))
              else r[1:0] end
          from (select *, list_filter(r, lambda p: p.nk = nk)[1] as x from (
            select w.user_id, e.i, e.op, e.preset_id, e.name, e.nk, e.t, list_sort(list_filter(w.l, lambda p: e.t + p.neg <= 60 * 86400000000))[1:10] as r
            from w join numbered_changes e on e.user_id = w.user_id and e.i = w.i + 1))),
        z as (select user_id, list_sort(arg_max(l, i)) as l from w group by user_id)
        select user_id, l[k].id as preset_id, l[k].name as name, cast(k as int) as rank from (select user_id, l, unnest(range(1, len(l) + 1)) as k from z)""",
    "preset_reconcile": """
        select user_id, preset_id, bank_ids, categories, card_id, len(had) - len(bank_ids) + cast(coalesce(card, '') <> '' and card_id is null as int) as missing_count, len(bank_ids) = 0 and len(categories) = 0 and card_id is null as is_empty from repaired""",
    "preset_names": f"""
        with n as (select user_id, preset_id, bank_ids, categories, card_id, list_transform(bank_ids, lambda b: upper(b)) as s, list_transform(categories, lambda c: case c {' '.join(f"when '{k}' then '{v}'" for k, v in CATEGORY_LABELS.items())} else 'Other' end) as l from repaired)
        select n.user_id, n.preset_id, concat_ws(' · ', nullif(array_to_string(s[1:2], ', ') || case when len(s) > 2 then ' +' || (len(s) - 2) else '' end, ''), nullif(array_to_string(l[1:2], ', ') || case when len(l) > 2 then ' +' || (len(l) - 2) else '' end, '')) as suggested,
               concat_ws(' · ', case len(bank_ids) when 0 then null when 1 then '1 bank' else len(bank_ids) || ' banks' end, case len(categories) when 0 then null when 1 then '1 category' else len(categories) || ' categories' end, case when card_id is not null then '1 card' end) as summary from n""",
    "preset_match": """
        with k as (select user_id, preset_id, list_sort(list_distinct(bank_ids)) as b, list_sort(list_distinct(categories)) as c, coalesce(card_id, '') as k from preset)
        select user_id, preset_id as selection_id, min(preset_id) over (partition by user_id, b, c, k) as preset_id from k""",
    "log_filters": """
        select event_id, case when contains(url, 'bank=') then ['nation_1'] else [] end as bank_ids, case when contains(url, 'category=') then ['dining'] else [] end as categories, case when contains(url, 'card=') then 's1' end as card_id,
               case when contains(url, 'search=keells') then 'keells' end as search, 'relevance' as sort, case when contains(url, 'page=2') then 2 else 1 end as page, 12 as page_size from request_log""",
    "return_visits": "select event_id, is_return from visits",
    "visit_paths": """
        with p as (select is_return, contains(url, 'search=keells') as s, contains(url, 'bank=') or contains(url, 'card=') as f from visits)
        select case when s or f or is_return then '/__analytics' || case when is_return then '/return-visit' else '' end || case when s then '/search' when f then '/filter' else '' end else 'untouched' end as path, count(*) as visits from p group by 1""",
    "rate_limit": """
        with q as (select event_id, client_key, ts, row_number() over (partition by client_key order by ts, event_id) as i from request_log where not contains(lower(user_agent), 'googlebot')),
        w as (select event_id, client_key, i, ts, ts as opened, 1 as n from q where i = 1
              union all select q.event_id, q.client_key, q.i, q.ts, case when q.ts - w.opened >= interval 1 day then q.ts else w.opened end, case when q.ts - w.opened >= interval 1 day then 1 else w.n + 1 end from w join q on q.client_key = w.client_key and q.i = w.i + 1)
        select event_id, client_key, n > 3 as blocked from w""",
    "sort_relevance": "select id, last_seen_at, valid_until, seq from active",
    "sort_newest": "select id, last_seen_at, valid_until, seq from active",
    "sort_expiring": "select id, last_seen_at, valid_until, seq from active",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(body, recursive=name in ("rate_limit", "preset_upsert")) for name, body in BODIES.items()}
