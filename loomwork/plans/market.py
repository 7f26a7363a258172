"""The market warehouse: 7 staging, 4 intermediate and 6 mart models over all-string raw tables.

Where rows tie for "the best of a group", the row's own key decides, so results do not vary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import col, filled, latest, safe, surrogate_key

from .registry import DataTest, Exposure, Project

project = Project("market")

for _table, _group in {
    "coingecko_coins_markets": "coingecko", "coingecko_coins_detail": "coingecko", "coingecko_exchanges": "coingecko",
    "defi_llama_protocols": "defi_llama", "defi_llama_yields_pools": "defi_llama",
    "etherscan_eth_transactions": "etherscan", "etherscan_token_transfers": "etherscan",
}.items():
    project.source(_table, _group)

#: The wallet addresses that are tracked.
TRACKED = (
    "0xbe0eb53f46cd790cd13851d5eff43d12404d33e8",
    "0xda9dfa130df4de4673b89022ee50ff26f6ea73cf",
    "0x1b3cb81e51011b549d78bf720b0d924ac763a7c2",
)

PRICE, MONEY, SHARE, AMOUNT = "decimal(38,8)", "decimal(38,2)", "decimal(18,8)", "decimal(38,18)"


def renamed(df: DataFrame, key: str, **outputs) -> DataFrame:
    """Project ``outputs`` (name=column or expression) of the rows that have ``key``."""
    return df.filter(col(key).isNotNull()).select(*[col(e).alias(n) for n, e in outputs.items()])


def json_at(column: str, path: str):
    return F.get_json_object(col(column), path)


@project.model("coingecko_coins_markets", layer="staging")
def stg_coingecko__coins_markets(raw: DataFrame) -> DataFrame:
    """Typed coin market data, a row per coin."""
    return renamed(
        raw, "id", coin_id="id", symbol="symbol", coin_name="name",
        current_price_usd=safe("current_price", PRICE), market_cap_usd=safe("market_cap", MONEY), total_volume_usd=safe("total_volume", MONEY),
        price_change_pct_24h=safe("price_change_percentage_24h", SHARE), market_cap_rank=safe("market_cap_rank", "int"),
        all_time_high_usd=safe("ath", PRICE), last_updated_at=safe("last_updated", "timestamp"))


@project.model("coingecko_coins_detail", layer="staging")
def stg_coingecko__coins_detail(raw: DataFrame) -> DataFrame:
    """Coin metadata taken out of JSON strings, a row per coin."""
    return renamed(
        raw, "id", coin_id="id", symbol="symbol", coin_name="name", description=json_at("description", "$.en"), categories="categories",
        homepage_url=json_at("links", "$.homepage[0]"), github_url=json_at("links", "$.repos_url.github[0]"), genesis_date=safe("genesis_date", "date"),
        developer_forks=safe(json_at("developer_data", "$.forks"), "int"), developer_stars=safe(json_at("developer_data", "$.stars"), "int"),
        twitter_followers=safe(json_at("community_data", "$.twitter_followers"), "int"))


@project.model("coingecko_exchanges", layer="staging")
def stg_coingecko__exchanges(raw: DataFrame) -> DataFrame:
    """Exchange attributes, a row per exchange."""
    return renamed(
        raw, "id", exchange_id="id", exchange_name="name", year_established=safe("year_established", "int"), country="country",
        trust_score=safe("trust_score", "int"), trust_score_rank=safe("trust_score_rank", "int"),
        trade_volume_24h_btc=safe("trade_volume_24h_btc", PRICE), url="url")


@project.model("defi_llama_protocols", layer="staging")
def stg_defi_llama__protocols(raw: DataFrame) -> DataFrame:
    """Protocol attributes, a row per protocol."""
    return renamed(
        raw, "id", protocol_id="id", protocol_name="name", symbol="symbol", category="category", chains="chains", tvl_usd=safe("tvl", MONEY),
        change_1d_pct=safe("change_1d", SHARE), change_7d_pct=safe("change_7d", SHARE), audit_count=safe("audits", "int"), url="url", slug="slug")


@project.model("defi_llama_yields_pools", layer="staging")
def stg_defi_llama__yields_pools(raw: DataFrame) -> DataFrame:
    """Yield pools, a row per pool."""
    return renamed(
        raw, "pool", pool_id="pool", chain="chain", project_name="project", symbol="symbol", tvl_usd=safe("tvlUsd", MONEY), apy=safe("apy", SHARE),
        apy_base=safe("apyBase", SHARE), apy_reward=safe("apyReward", SHARE), is_stablecoin=F.lower("stablecoin") == "true")


@project.model("etherscan_eth_transactions", layer="staging")
def stg_etherscan__transactions(raw: DataFrame) -> DataFrame:
    """Transactions, the newest row of each hash."""
    newest = latest(raw.filter(col("hash").isNotNull()), ["hash"], safe("blockNumber", "bigint").desc(), *map(col, ("from", "to", "value", "gasUsed", "gasPrice", "timeStamp", "isError")))
    sender, receiver = F.lower(col("from")), F.lower(col("to"))
    return renamed(
        newest, "hash", tx_hash="hash", block_number=safe("blockNumber", "bigint"), tx_timestamp=F.timestamp_seconds(safe("timeStamp", "bigint")),
        from_address=sender, to_address=receiver, value_eth=(safe("value", "decimal(38,0)") / F.lit(1e18)).cast(AMOUNT), gas_used=safe("gasUsed", "bigint"),
        gas_price_gwei=(safe("gasPrice", "decimal(38,0)") / F.lit(1e9)).cast("decimal(38,9)"), is_error=col("isError") == "1",
        tracked_address=F.when(sender.isin(*TRACKED), sender).when(receiver.isin(*TRACKED), receiver))


@project.model("etherscan_token_transfers", layer="staging")
def stg_etherscan__token_transfers(raw: DataFrame) -> DataFrame:
    """Token transfers, the newest row of each (hash, from, to, contract, value)."""
    keyed = raw.filter(col("hash").isNotNull()).withColumn("transfer_id", surrogate_key("hash", "from", "to", "contractAddress", "value"))
    newest = latest(keyed, ["transfer_id"], safe("blockNumber", "bigint").desc(), *map(col, ("timeStamp", "tokenSymbol", "tokenDecimal", "tokenName")))
    scaled = safe("value", "double") / F.pow(F.lit(10), safe("tokenDecimal", "int"))
    return renamed(
        newest, "hash", transfer_id="transfer_id", tx_hash="hash", block_number=safe("blockNumber", "bigint"),
        tx_timestamp=F.timestamp_seconds(safe("timeStamp", "bigint")), from_address=F.lower(col("from")), to_address=F.lower(col("to")),
        token_amount=scaled.cast(AMOUNT), token_name="tokenName", token_symbol="tokenSymbol", contract_address=F.lower("contractAddress"))


@project.model("stg_coingecko__coins_markets", "stg_coingecko__coins_detail", "stg_defi_llama__protocols", "stg_etherscan__token_transfers", layer="intermediate")
def int_token_profiles(markets: DataFrame, detail: DataFrame, protocols: DataFrame, transfers: DataFrame) -> DataFrame:
    """Market data with metadata, the largest protocol and the first contract of the coin's symbol."""
    largest = latest(protocols.filter(filled("symbol")).select(F.upper("symbol").alias("p_symbol"), "protocol_id", "protocol_name", "tvl_usd", "category"),
                     ["p_symbol"], F.col("tvl_usd").desc_nulls_last(), F.col("protocol_id"))
    contracts = (transfers.filter("token_symbol is not null").groupBy(F.upper("token_symbol").alias("t_symbol"))
                 .agg(F.when(F.count_if(F.col("contract_address").isNull()) == 0, F.min("contract_address")).alias("contract_address")))
    extra = detail.select("coin_id", "description", "categories", "homepage_url", "github_url", "genesis_date", "developer_forks", "developer_stars")
    symbol = F.upper(markets["symbol"])
    return (markets.join(extra, "coin_id", "left").join(largest, symbol == largest["p_symbol"], "left").join(contracts, symbol == contracts["t_symbol"], "left")
            .select("coin_id", "symbol", "coin_name", "current_price_usd", "market_cap_usd", "total_volume_usd", "market_cap_rank", "price_change_pct_24h",
                    "all_time_high_usd", *extra.columns[1:], "protocol_id", "protocol_name", F.col("tvl_usd").alias("protocol_tvl_usd"),
                    F.col("category").alias("protocol_category"), "contract_address"))


@project.model("stg_defi_llama__protocols", "stg_defi_llama__yields_pools", layer="intermediate")
def int_protocol_metrics(protocols: DataFrame, pools: DataFrame) -> DataFrame:
    """Protocols with the averages and sums of their pools."""
    sums = (pools.filter("project_name is not null").groupBy("project_name")
            .agg(F.avg("apy").alias("avg_apy"), F.sum("tvl_usd").alias("total_pool_tvl"), F.count("*").alias("n")))
    return (protocols.join(sums, F.lower("slug") == F.lower("project_name"), "left")
            .select("protocol_id", "protocol_name", "symbol", "category", "tvl_usd", "change_1d_pct", "change_7d_pct", "avg_apy", "total_pool_tvl",
                    F.coalesce("n", F.lit(0)).alias("pool_count")))


@project.model("stg_etherscan__transactions", "stg_etherscan__token_transfers", layer="intermediate")
def int_whale_activity(transactions: DataFrame, transfers: DataFrame) -> DataFrame:
    """Sent value, count and counterparties of each address over both kinds of transfer."""
    sides = [df.select(F.col("from_address").alias("address"), F.col("to_address").alias("counterparty"), F.col(v).alias("transfer_value"))
             for df, v in ((transactions, "value_eth"), (transfers, "token_amount"))]
    return (sides[0].unionByName(sides[1]).filter("address is not null").groupBy("address")
            .agg(F.count("*").alias("tx_count"), F.sum("transfer_value").alias("total_value"), F.countDistinct("counterparty").alias("unique_counterparties")))


@project.model("stg_coingecko__exchanges", "stg_coingecko__coins_markets", layer="intermediate")
def int_exchange_token_coverage(exchanges: DataFrame, markets: DataFrame) -> DataFrame:
    """Each of the first 10 exchanges with each of the first 20 coins."""
    venues = exchanges.filter("trust_score_rank <= 10").select("exchange_id", "exchange_name", "trust_score")
    coins = markets.filter("market_cap_rank <= 20").select("coin_id", "symbol", "coin_name", "market_cap_usd")
    return venues.crossJoin(coins).select(surrogate_key("exchange_id", "coin_id").alias("coverage_id"), *venues.columns, *coins.columns)


@project.model("int_token_profiles", "int_whale_activity", layer="marts", materialized="table")
def fct_daily_token_metrics(profiles: DataFrame, whales: DataFrame) -> DataFrame:
    """Token profiles with the activity of their contract's address."""
    kept = ["coin_id", "symbol", "coin_name", "current_price_usd", "market_cap_usd", "total_volume_usd", "market_cap_rank", "price_change_pct_24h",
            "all_time_high_usd", "protocol_id", "protocol_name", "protocol_tvl_usd"]
    counts = ("tx_count", "total_value", "unique_counterparties")
    return profiles.join(whales, profiles["contract_address"] == whales["address"], "left").select(
        *kept, *[F.coalesce(c, F.lit(0)).alias(f"whale_{c}") for c in counts])


@project.model("int_protocol_metrics", "int_token_profiles", layer="marts", materialized="table")
def fct_protocol_health(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Protocols that have a symbol, with the largest coin of that symbol as governance token."""
    coins = latest(profiles.filter("symbol is not null").select(F.upper("symbol").alias("g_symbol"), "coin_id", "current_price_usd", "price_change_pct_24h", "market_cap_usd"),
                   ["g_symbol"], F.col("market_cap_usd").desc_nulls_last(), F.col("coin_id"))
    return (metrics.filter(filled("symbol")).join(coins, F.upper(metrics["symbol"]) == coins["g_symbol"], "left")
            .select(*[metrics[c] for c in metrics.columns], F.col("current_price_usd").alias("governance_token_price_usd"),
                    F.col("price_change_pct_24h").alias("governance_token_change_24h"), F.col("market_cap_usd").alias("governance_token_market_cap_usd")))


@project.model("int_whale_activity", "int_token_profiles", layer="marts", materialized="table")
def fct_whale_movements(whales: DataFrame, profiles: DataFrame) -> DataFrame:
    """Whale activity with the largest token whose contract is the address."""
    tokens = latest(profiles.filter("contract_address is not null").select(
        "contract_address", F.col("coin_id").alias("token_coin_id"), F.col("symbol").alias("token_symbol"), F.col("coin_name").alias("token_name"), "market_cap_usd"),
        ["contract_address"], F.col("market_cap_usd").desc_nulls_last(), F.col("token_coin_id"))
    return whales.join(tokens, whales["address"] == tokens["contract_address"], "left").select(
        "address", "tx_count", "total_value", "unique_counterparties", "token_coin_id", "token_symbol", "token_name")


@project.model("stg_coingecko__coins_detail", layer="marts", materialized="table")
def dim_tokens(detail: DataFrame) -> DataFrame:
    """Token metadata."""
    return detail.drop("twitter_followers")


@project.model("stg_defi_llama__protocols", layer="marts", materialized="table")
def dim_protocols(protocols: DataFrame) -> DataFrame:
    """Protocols."""
    return protocols.select(*protocols.columns)


@project.model("stg_coingecko__exchanges", layer="marts", materialized="table")
def dim_exchanges(exchanges: DataFrame) -> DataFrame:
    """Exchanges."""
    return exchanges.select(*exchanges.columns)


#: Key columns (unique and not null), other not-null columns, and parents of keys.
KEYS = {
    "stg_coingecko__coins_markets": "coin_id", "stg_coingecko__coins_detail": "coin_id", "stg_coingecko__exchanges": "exchange_id",
    "stg_defi_llama__protocols": "protocol_id", "stg_defi_llama__yields_pools": "pool_id", "stg_etherscan__transactions": "tx_hash",
    "stg_etherscan__token_transfers": "transfer_id", "int_token_profiles": "coin_id", "int_protocol_metrics": "protocol_id",
    "int_whale_activity": "address", "int_exchange_token_coverage": "coverage_id", "fct_daily_token_metrics": "coin_id",
    "fct_protocol_health": "protocol_id", "fct_whale_movements": "address", "dim_tokens": "coin_id", "dim_protocols": "protocol_id", "dim_exchanges": "exchange_id",
}
NOT_NULL = [
    ("stg_coingecko__coins_markets", "symbol"), ("stg_coingecko__coins_detail", "symbol"), ("stg_coingecko__exchanges", "exchange_name"),
    ("stg_defi_llama__protocols", "protocol_name"), ("stg_defi_llama__yields_pools", "project_name"), ("stg_etherscan__transactions", "from_address"),
    ("stg_etherscan__token_transfers", "tx_hash"), ("int_exchange_token_coverage", "exchange_id"), ("int_exchange_token_coverage", "coin_id"),
]
PARENTS = [
    ("int_token_profiles", "coin_id", "stg_coingecko__coins_markets"), ("int_protocol_metrics", "protocol_id", "stg_defi_llama__protocols"),
    ("int_exchange_token_coverage", "exchange_id", "stg_coingecko__exchanges"), ("int_exchange_token_coverage", "coin_id", "stg_coingecko__coins_markets"),
    ("fct_protocol_health", "protocol_id", "dim_protocols"), ("fct_whale_movements", "address", "int_whale_activity"),
    ("dim_tokens", "coin_id", "fct_daily_token_metrics"),
]
for _model, _key in KEYS.items():
    project.tests += [DataTest("unique", _model, _key), DataTest("not_null", _model, _key)]
project.tests += [DataTest("not_null", m, c) for m, c in NOT_NULL]
project.tests += [DataTest("relationships", m, c, p, c) for m, c, p in PARENTS]
project.tests += [
    DataTest("custom", "fct_daily_token_metrics", "market_cap_usd", failing="market_cap_usd < 0"),
    DataTest("custom", "dim_protocols", "tvl_usd", failing="lower(category) like '%defi%' and tvl_usd is null"),
    DataTest("custom", "stg_etherscan__token_transfers", "token_amount", failing="token_amount < 0"),
]
for _e in (
    Exposure("defi_market_slack_bot", "application", "high", "high", ("fct_daily_token_metrics", "fct_protocol_health")),
    Exposure("whale_alert_pipeline", "ml", "medium", "medium", ("fct_whale_movements", "dim_tokens")),
):
    project.exposures[_e.name] = _e
