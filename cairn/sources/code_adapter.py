"""A code graph over the driver's tables: files, symbols, references, imports and their kin.

The tables hold no source code, so parts stand for files, line items for references, and so on. As in
``adapter``, each view is SQL that Spark and DuckDB both take.
"""

from __future__ import annotations

_C = "cast({} as varchar(20))"


def _s(x: str) -> str:
    return f"cast({x} as varchar(20))"


_PATH = f"concat(case when p_partkey % 11 = 0 then 'tests/' when p_partkey % 13 = 0 then 'src/generated/' else 'src/' end, lower(replace(p_brand, '#', '')), '/mod_', {_s('p_partkey')}, case p_size % 5 when 0 then '.rs' when 1 then '.py' when 2 then '.ts' when 3 then '.go' else '.h' end)"
_LANG = "case p_size % 5 when 0 then 'rust' when 1 then 'python' when 2 then 'typescript' when 3 then 'go' else 'c' end"

VIEWS: dict[str, str] = {
    "code_files": f"select concat('scope', {_s('p_partkey % 3')}) as scope, {_s('p_partkey')} as file_id, {_PATH} as path, {_LANG} as language_id, case when p_partkey % 13 = 0 then true else false end as is_generated, cast(p_retailprice * 10 as bigint) as byte_len, concat('h', {_s('p_partkey * 31 % 9973')}) as blob_hash, case when p_partkey % 17 = 0 then 'degraded' else 'parsed' end as parse_status from part",
    "code_symbols": f"select scope, concat('sym:', file_id, ':', {_s('k')}) as symbol_id, file_id, path, language_id, is_generated, concat(case when k = 1 then 'Type' else 'fn_' end, {_s('(cast(file_id as bigint) * 7 + k * 131) % 900')}) as name, case k when 0 then 'function' when 1 then 'class' else 'method' end as kind, cast(k * 20 + 1 as bigint) as line_start, cast(k * 20 + 15 as bigint) as line_end from code_files cross join (select 0 as k union all select 1 union all select 2) three",
    "code_refs": f"select f.scope, concat('ref:', {_s('l_orderkey')}, ':', {_s('l_linenumber')}, ':', {_s('l_partkey')}) as ref_id, f.file_id, f.path, concat('fn_', {_s('(l_suppkey * 3 + l_linenumber * 131) % 1000')}) as name, case when l_returnflag = 'N' then 'type' else 'call' end as kind, cast(1 + l_orderkey % 60 as bigint) as line from lineitem join code_files f on f.file_id = {_s('l_partkey')}",
    "code_imports": f"select f.scope, concat('imp:', {_s('o_orderkey')}) as import_id, f.file_id, f.path, f.language_id, case when o_orderkey % 6 = 0 then './local' when o_orderkey % 6 = 1 then 'crate::util' else concat('brand', {_s('1 + o_orderkey % 25')}, case when o_orderkey % 2 = 0 then '.' else '::' end, 'mod_', {_s('o_custkey % 250')}) end as module, cast(1 + o_orderkey % 9 as bigint) as line, case when o_orderkey % 5 = 0 then 'resolved' else 'unresolved' end as resolution from orders join code_files f on f.file_id = {_s('o_orderkey % 200')}",
    "code_deps": f"select concat('scope', {_s('c_custkey % 3')}) as scope, concat('dep:', {_s('c_custkey')}) as dep_id, case c_nationkey % 3 when 0 then 'Cargo.toml' when 1 then 'package-lock.json' else 'go.mod' end as path, case c_nationkey % 3 when 0 then 'cargo' when 1 then 'npm' else 'go' end as ecosystem, concat('pkg-', lower(c_mktsegment), '-', {_s('c_custkey % 40')}) as package_name, concat('^', {_s('c_nationkey')}, '.1') as requirement, case when c_nationkey % 3 = 1 then true else false end as is_lockfile, cast(1 + c_custkey % 90 as bigint) as line from customer",
    "code_flags": f"select concat('scope', {_s('user_id % 3')}) as scope, concat('use:', {_s('event_id')}) as usage_id, concat('FLAG_', upper(event_type), '_', {_s('user_id % 20')}) as name, case user_id % 3 when 0 then 'guards_code' when 1 then 'defines_config' else 'reads_config' end as edge_kind, cast(5000 + event_id % 5000 as bigint) as confidence, {_s('event_id % 200')} as file_id, cast(1 + event_id % 60 as bigint) as line from events",
    "code_routes": f"select concat('scope', {_s('page_id % 3')}) as scope, concat('route:', {_s('page_id')}) as route_id, case page_id % 4 when 0 then concat('/api/v1/items/', {_s('page_id % 30')}) when 1 then '/api/v1/items/:id' when 2 then '/api/<version>/items/{{id}}' else concat('/pages/', {_s('page_id')}) end as url, case page_id % 3 when 0 then 'GET' when 1 then 'POST' else 'DELETE' end as http_method, concat('handler_', {_s('page_id % 40')}) as handler, {_s('page_id % 200')} as file_id, cast(1 + page_id % 80 as bigint) as line from pages".replace("{{", "{").replace("}}", "}"),
    "code_chunks": "select scope, concat('chunk:', symbol_id) as chunk_id, symbol_id, file_id, path, language_id, is_generated, line_start, line_end, concat(kind, ' ', name, ' in ', path, ' returns retry policy ', kind) as content from code_symbols",
    "code_calls": "select r.scope, r.ref_id as call_id, r.file_id, r.path, r.name as callee, s.symbol_id as caller_id, s.name as caller, r.line from code_refs r join code_symbols s on s.file_id = r.file_id and r.line >= s.line_start and r.line <= s.line_end where r.kind = 'call'",
    "repo_members": "select 'scope0' as scope, 'alpha' as alias, cast(5 as bigint) as priority, false as stale union all select 'scope1', 'beta', cast(0 as bigint), true union all select 'scope2', 'gamma', cast(-3 as bigint), false",
}
