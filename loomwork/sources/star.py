"""The seven raw market tables, derived from the star schema at any scale.

All columns are strings, as a loader of JSON records leaves them, with junk,
nulls, mixed case, nested JSON and repeated keys. Each expression is plain SQL
that other engines run too, so ``SQL`` also feeds the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomwork.session import table

STAMP = "'2024-02-01T00:00:00+00:00' as _extracted_at"


def _money(expression: str) -> str:
    return f"cast(cast({expression} as decimal(18,2)) as varchar(40))"


def _text(expression: str) -> str:
    return f"cast({expression} as varchar(40))"


SQL: dict[str, str] = {
    "coingecko_coins_markets": f"""
        select 'coin-' || {_text('p_partkey')} as id, 't' || {_text('p_partkey % 700')} as symbol, p_name as name,
               {_money('p_retailprice')} as current_price,
               case when p_partkey % 17 = 0 then null when p_partkey % 23 = 0 then 'n/a' else {_money('p_partkey * 1000 + p_size')} end as market_cap,
               {_money('p_size * 250')} as total_volume, {_text('p_size - 25')} as price_change_percentage_24h,
               {_text('p_partkey')} as market_cap_rank, {_money('p_retailprice')} as ath, '2024-01-31 12:00:00' as last_updated, {STAMP}
        from part""",
    "coingecko_coins_detail": f"""
        select 'coin-' || {_text('p_partkey')} as id, 't' || {_text('p_partkey % 700')} as symbol, p_name as name,
               '{{"en": "' || p_type || '"}}' as description, '["' || p_brand || '"]' as categories,
               '{{"homepage": ["https://h/' || {_text('p_partkey')} || '"], "repos_url": {{"github": ["https://g/' || {_text('p_partkey')} || '"]}}}}' as links,
               case when p_partkey % 7 = 0 then 'unknown' else '2015-07-30' end as genesis_date,
               '{{"forks": ' || {_text('p_size')} || ', "stars": ' || {_text('p_size * 3')} || '}}' as developer_data,
               '{{"twitter_followers": ' || {_text('p_partkey')} || '}}' as community_data, {STAMP}
        from part where p_partkey % 5 = 0""",
    "coingecko_exchanges": f"""
        select case when s_suppkey % 41 = 0 then null else 'ex-' || {_text('s_suppkey')} end as id, s_name as name,
               {_text('2000 + s_suppkey % 20')} as year_established, {_text('s_nationkey')} as country, {_text('s_suppkey % 10')} as trust_score,
               {_text('s_suppkey')} as trust_score_rank, {_money('s_acctbal')} as trade_volume_24h_btc, 'https://x/' || {_text('s_suppkey')} as url, {STAMP}
        from supplier""",
    "defi_llama_protocols": f"""
        select {_text('c_custkey')} as id, c_name as name,
               case when c_custkey % 13 = 0 then null when c_custkey % 11 = 0 then '' else 'T' || {_text('c_custkey % 900')} end as symbol,
               c_mktsegment as category, case when c_custkey % 2 = 0 then '["a", "b"]' else '["a"]' end as chains,
               case when c_custkey % 19 = 0 then 'junk' else {_money('c_acctbal * 1000')} end as tvl,
               {_text('c_custkey % 9 - 4')} as change_1d, {_text('c_custkey % 21 - 10')} as change_7d, {_text('c_custkey % 4')} as audits,
               'https://p/' || {_text('c_custkey')} as url, 'Proj-' || {_text('c_custkey')} as slug, {STAMP}
        from customer""",
    "defi_llama_yields_pools": f"""
        select {_text('o_orderkey')} as pool, o_orderstatus as chain, 'proj-' || {_text('o_custkey')} as project, o_orderpriority as symbol,
               {_money('o_totalprice')} as "tvlUsd", {_money('o_orderkey % 100')} as apy, {_money('o_orderkey % 10')} as "apyBase",
               case when o_orderkey % 3 = 0 then null else '1' end as "apyReward",
               case when o_orderkey % 5 = 0 then null when o_orderkey % 2 = 0 then 'True' else 'false' end as stablecoin, {STAMP}
        from orders""",
    "etherscan_eth_transactions": f"""
        select '0x' || {_text('l_orderkey')} as hash, {_text('l_orderkey * 10 + l_linenumber')} as "blockNumber", {_text('1700000000 + l_orderkey')} as "timeStamp",
               case when l_suppkey % 50 = 1 then '0xBE0EB53F46CD790CD13851D5EFF43D12404D33E8' else 'W' || {_text('l_suppkey')} end as "from",
               case when l_partkey % 40 = 1 then '0xDA9DFA130DF4DE4673B89022EE50FF26F6EA73CF' else 'C' || {_text('l_partkey')} end as "to",
               {_text('cast(l_quantity as bigint)')} || '000000000000000000' as value, {_text('21000 + l_linenumber')} as "gasUsed",
               '2000000000' as "gasPrice", case when l_linenumber % 4 = 0 then '1' else '0' end as "isError", {STAMP}
        from lineitem""",
    "etherscan_token_transfers": f"""
        select '0y' || {_text('l_orderkey')} as hash, {_text('l_orderkey * 10 + l_linenumber')} as "blockNumber", {_text('1700000000 + l_orderkey')} as "timeStamp",
               'W' || {_text('l_suppkey')} as "from", 'C' || {_text('l_partkey')} as "to", {_text('cast(l_quantity as bigint)')} || '000000' as value,
               'W' || {_text('l_partkey % 90')} as "contractAddress", 'Token ' || {_text('l_partkey % 700')} as "tokenName",
               case when l_linenumber = 7 then null else 'T' || {_text('l_partkey % 700')} end as "tokenSymbol",
               case when l_linenumber = 6 then null else '6' end as "tokenDecimal", {STAMP}
        from lineitem""",
}

TABLES = ("part", "supplier", "customer", "orders", "lineitem")


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw tables as lazy frames."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return {name: spark.sql(re.sub(r'as "(\w+)"', r"as `\1`", sql.replace("varchar(40)", "string")))
            for name, sql in SQL.items()}
