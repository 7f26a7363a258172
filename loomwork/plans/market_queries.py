"""Queries and oracle SQL of the market warehouse over the star-schema tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, TimestampType

from loomwork.functions.columns import KEY_NULL
from loomwork.sources.star import SQL, raw_tables

from .market import TRACKED, project


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles of six places, times as strings: what two engines can be compared by."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, DecimalType):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, TimestampType | DateType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def model(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(project.build(spark, raw_tables(spark, sf_dir), {name})[name])


def _num(kind: str, **columns: str) -> str:
    return ", ".join(f"try_cast({raw} as {kind}) as {name}" for name, raw in columns.items())


_KEY = "md5(concat_ws('-', {}))"


def _key(*fields: str) -> str:
    return _KEY.format(", ".join(f"coalesce(cast({f} as varchar), '{KEY_NULL}')" for f in fields))


_IN = ", ".join(f"'{a}'" for a in TRACKED)

#: The models in the oracle's dialect; decimals are doubles there, which the comparison rounds.
MODEL_SQL: dict[str, str] = {
    "stg_coingecko__coins_markets": f"""
        select id as coin_id, symbol, name as coin_name,
               {_num('double', current_price_usd='current_price', market_cap_usd='market_cap', total_volume_usd='total_volume', price_change_pct_24h='price_change_percentage_24h')},
               try_cast(market_cap_rank as int) as market_cap_rank, try_cast(ath as double) as all_time_high_usd,
               strftime(try_cast(last_updated as timestamp), '%Y-%m-%d %H:%M:%S') as last_updated_at
        from coingecko_coins_markets where id is not null""",
    "stg_coingecko__coins_detail": """
        select id as coin_id, symbol, name as coin_name, json_extract_string(description, '$.en') as description, categories,
               json_extract_string(links, '$.homepage[0]') as homepage_url, json_extract_string(links, '$.repos_url.github[0]') as github_url,
               strftime(try_cast(genesis_date as date), '%Y-%m-%d %H:%M:%S') as genesis_date,
               try_cast(json_extract_string(developer_data, '$.forks') as int) as developer_forks,
               try_cast(json_extract_string(developer_data, '$.stars') as int) as developer_stars,
               try_cast(json_extract_string(community_data, '$.twitter_followers') as int) as twitter_followers
        from coingecko_coins_detail where id is not null""",
    "stg_coingecko__exchanges": f"""
        select id as exchange_id, name as exchange_name, {_num('int', year_established='year_established')}, country,
               {_num('int', trust_score='trust_score', trust_score_rank='trust_score_rank')}, {_num('double', trade_volume_24h_btc='trade_volume_24h_btc')}, url
        from coingecko_exchanges where id is not null""",
    "stg_defi_llama__protocols": f"""
        select id as protocol_id, name as protocol_name, symbol, category, chains, {_num('double', tvl_usd='tvl', change_1d_pct='change_1d', change_7d_pct='change_7d')},
               {_num('int', audit_count='audits')}, url, slug
        from defi_llama_protocols where id is not null""",
    "stg_defi_llama__yields_pools": f"""
        select pool as pool_id, chain, project as project_name, symbol, {_num('double', tvl_usd='"tvlUsd"', apy='apy', apy_base='"apyBase"', apy_reward='"apyReward"')},
               lower(stablecoin) = 'true' as is_stablecoin
        from defi_llama_yields_pools where pool is not null""",
    "stg_etherscan__transactions": f"""
        select hash as tx_hash, try_cast("blockNumber" as bigint) as block_number,
               strftime(make_timestamp(1000000 * try_cast("timeStamp" as bigint)), '%Y-%m-%d %H:%M:%S') as tx_timestamp,
               lower("from") as from_address, lower("to") as to_address, round(try_cast(value as double) / 1e18, 6) as value_eth,
               try_cast("gasUsed" as bigint) as gas_used, round(try_cast("gasPrice" as double) / 1e9, 6) as gas_price_gwei, "isError" = '1' as is_error,
               case when lower("from") in ({_IN}) then lower("from") when lower("to") in ({_IN}) then lower("to") end as tracked_address
        from etherscan_eth_transactions where hash is not null
        qualify row_number() over (partition by hash order by try_cast("blockNumber" as bigint) desc, "from", "to", value, "gasUsed", "gasPrice", "timeStamp", "isError") = 1""",
    "stg_etherscan__token_transfers": f"""
        select {_key('hash', '"from"', '"to"', '"contractAddress"', 'value')} as transfer_id, hash as tx_hash, try_cast("blockNumber" as bigint) as block_number,
               strftime(make_timestamp(1000000 * try_cast("timeStamp" as bigint)), '%Y-%m-%d %H:%M:%S') as tx_timestamp,
               lower("from") as from_address, lower("to") as to_address, round(try_cast(value as double) / pow(10, try_cast("tokenDecimal" as int)), 6) as token_amount,
               "tokenName" as token_name, "tokenSymbol" as token_symbol, lower("contractAddress") as contract_address
        from etherscan_token_transfers where hash is not null
        qualify row_number() over (partition by transfer_id order by try_cast("blockNumber" as bigint) desc, "timeStamp", "tokenSymbol" nulls first, "tokenDecimal" nulls first, "tokenName" nulls first) = 1""",
    "int_token_profiles": """
        with largest as (select upper(symbol) as u, protocol_id, protocol_name, tvl_usd, category from stg_defi_llama__protocols
                         where symbol is not null and symbol <> '' qualify row_number() over (partition by upper(symbol) order by tvl_usd desc nulls last, protocol_id) = 1),
             contracts as (select upper(token_symbol) as u, contract_address from stg_etherscan__token_transfers
                           where token_symbol is not null qualify row_number() over (partition by upper(token_symbol) order by contract_address nulls first) = 1)
        select m.coin_id, m.symbol, m.coin_name, m.current_price_usd, m.market_cap_usd, m.total_volume_usd, m.market_cap_rank, m.price_change_pct_24h,
               m.all_time_high_usd, d.description, d.categories, d.homepage_url, d.github_url, d.genesis_date, d.developer_forks, d.developer_stars,
               p.protocol_id, p.protocol_name, p.tvl_usd as protocol_tvl_usd, p.category as protocol_category, c.contract_address
        from stg_coingecko__coins_markets m left join stg_coingecko__coins_detail d on m.coin_id = d.coin_id
             left join largest p on upper(m.symbol) = p.u left join contracts c on upper(m.symbol) = c.u""",
    "int_protocol_metrics": """
        select p.protocol_id, p.protocol_name, p.symbol, p.category, p.tvl_usd, p.change_1d_pct, p.change_7d_pct, round(a.avg_apy, 6) as avg_apy,
               round(a.total_pool_tvl, 6) as total_pool_tvl, coalesce(a.n, 0) as pool_count
        from stg_defi_llama__protocols p left join (
            select project_name, avg(apy) as avg_apy, sum(cast(tvl_usd as decimal(38,2)))::double as total_pool_tvl, count(*) as n
            from stg_defi_llama__yields_pools where project_name is not null group by project_name) a on lower(p.slug) = lower(a.project_name)""",
    "int_whale_activity": """
        select address, count(*) as tx_count, round(sum(v), 6) as total_value, count(distinct counterparty) as unique_counterparties
        from (select from_address as address, to_address as counterparty, value_eth as v from stg_etherscan__transactions
              union all select from_address, to_address, token_amount from stg_etherscan__token_transfers)
        where address is not null group by address""",
    "int_exchange_token_coverage": f"""
        select {_key('exchange_id', 'coin_id')} as coverage_id, exchange_id, exchange_name, trust_score, coin_id, symbol, coin_name, market_cap_usd
        from (select * from stg_coingecko__exchanges where trust_score_rank <= 10)
             cross join (select coin_id, symbol, coin_name, market_cap_usd from stg_coingecko__coins_markets where market_cap_rank <= 20)""",
    "fct_daily_token_metrics": """
        select t.coin_id, t.symbol, t.coin_name, t.current_price_usd, t.market_cap_usd, t.total_volume_usd, t.market_cap_rank, t.price_change_pct_24h,
               t.all_time_high_usd, t.protocol_id, t.protocol_name, t.protocol_tvl_usd, coalesce(w.tx_count, 0) as whale_tx_count,
               coalesce(w.total_value, 0) as whale_total_value, coalesce(w.unique_counterparties, 0) as whale_unique_counterparties
        from int_token_profiles t left join int_whale_activity w on t.contract_address = w.address""",
    "fct_protocol_health": """
        with g as (select upper(symbol) as u, current_price_usd, price_change_pct_24h, market_cap_usd from int_token_profiles where symbol is not null
                   qualify row_number() over (partition by upper(symbol) order by market_cap_usd desc nulls last, coin_id) = 1)
        select p.*, g.current_price_usd as governance_token_price_usd, g.price_change_pct_24h as governance_token_change_24h,
               g.market_cap_usd as governance_token_market_cap_usd
        from int_protocol_metrics p left join g on upper(p.symbol) = g.u where p.symbol is not null and p.symbol <> ''""",
    "fct_whale_movements": """
        with t as (select contract_address, coin_id, symbol, coin_name from int_token_profiles where contract_address is not null
                   qualify row_number() over (partition by contract_address order by market_cap_usd desc nulls last, coin_id) = 1)
        select w.address, w.tx_count, w.total_value, w.unique_counterparties, t.coin_id as token_coin_id, t.symbol as token_symbol, t.coin_name as token_name
        from int_whale_activity w left join t on w.address = t.contract_address""",
    "dim_tokens": "select * exclude (twitter_followers) from stg_coingecko__coins_detail",
    "dim_protocols": "select * from stg_defi_llama__protocols",
    "dim_exchanges": "select * from stg_coingecko__exchanges",
}


def oracle(query: str, *models: str) -> str:
    """``query`` preceded by the CTEs of the models it names, and of all they need."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in needed:
            return
        for parent in project.models[name].inputs if name in project.models else ():
            need(parent)
        needed.append(name)

    for name in models:
        need(name)
    return "with " + ",\n".join(f"{n} as ({SQL.get(n) or MODEL_SQL[n]})" for n in needed) + "\n" + query


def _summary(mart: str, frame: Callable[[dict[str, DataFrame]], DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(frame(project.build(spark, raw_tables(spark, sf_dir), {mart, *more})))
    return run


def top_tokens(frames: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """The tokens of largest market cap."""
    df = frames["fct_daily_token_metrics"].filter("market_cap_usd is not null").orderBy(F.desc("market_cap_usd"), "coin_id").limit(limit)
    return df.select(F.col("coin_name").alias("token"), F.col("current_price_usd").alias("price"), F.col("market_cap_usd").alias("market_cap"),
                     F.col("total_volume_usd").alias("volume_24h"), F.col("price_change_pct_24h").alias("price_change_pct"))


def protocol_health(frames: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """The protocols of largest TVL with the number of chains they run on."""
    best = frames["fct_protocol_health"].filter("tvl_usd is not null").orderBy(F.desc("tvl_usd"), "protocol_id").limit(limit)
    chains = frames["dim_protocols"].select(F.col("protocol_id"), F.size(F.from_json("chains", "array<string>")).alias("chain_count"))
    return best.join(chains, "protocol_id", "left").select(
        F.col("protocol_name").alias("protocol"), F.col("tvl_usd").alias("tvl"), F.col("avg_apy").alias("avg_yield"), "chain_count")


def whale_movements(frames: dict[str, DataFrame], limit: int = 5) -> DataFrame:
    """The addresses that moved most."""
    best = frames["fct_whale_movements"].filter("total_value is not null").orderBy(F.desc("total_value"), "address").limit(limit)
    return best.select(F.coalesce("token_symbol", "token_name", F.lit("?")).alias("token"), F.col("total_value").alias("amount"), F.col("address").alias("from_addr"),
                       F.concat(F.lit("+"), F.col("unique_counterparties").cast("string"), F.lit(" cps")).alias("to_addr"), F.col("tx_count").alias("timestamp"))


def summaries(frames: dict[str, DataFrame]) -> dict[str, DataFrame | bool]:
    """All three sections, and whether one of them is empty (degraded)."""
    parts: dict[str, DataFrame | bool] = {"tokens": top_tokens(frames), "protocols": protocol_health(frames), "whales": whale_movements(frames)}
    return parts | {"degraded": any(p.isEmpty() for p in parts.values())}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    models = {f"model_{name}": functools.partial(model, name) for name in project.models}
    return models | {
        "summary_top_tokens": _summary("fct_daily_token_metrics", top_tokens),
        "summary_protocol_health": _summary("fct_protocol_health", protocol_health, "dim_protocols"),
        "summary_whale_movements": _summary("fct_whale_movements", whale_movements),
    }


def oracle_sql() -> dict[str, str]:
    models = {f"model_{name}": oracle(f"select * from {name}", name) for name in project.models}
    return models | {
        "summary_top_tokens": oracle("""select coin_name as token, current_price_usd as price, market_cap_usd as market_cap, total_volume_usd as volume_24h,
            price_change_pct_24h as price_change_pct from fct_daily_token_metrics where market_cap_usd is not null order by market_cap_usd desc, coin_id limit 10""", "fct_daily_token_metrics"),
        "summary_protocol_health": oracle("""select p.protocol_name as protocol, p.tvl_usd as tvl, p.avg_apy as avg_yield, json_array_length(d.chains)::int as chain_count
            from fct_protocol_health p left join dim_protocols d on p.protocol_id = d.protocol_id where p.tvl_usd is not null order by p.tvl_usd desc, p.protocol_id limit 10""",
            "fct_protocol_health", "dim_protocols"),
        "summary_whale_movements": oracle("""select coalesce(token_symbol, token_name, '?') as token, total_value as amount, address as from_addr,
            '+' || unique_counterparties || ' cps' as to_addr, tx_count as timestamp from fct_whale_movements where total_value is not null
            order by total_value desc, address limit 5""", "fct_whale_movements"),
    }
