"""The warehouse on hand-made raw tables, its tests, and its plans."""

from datetime import UTC, datetime

import pytest

from loomwork.operators import checks
from loomwork.plans.market import project
from loomwork.sources.versions import Versions
from loomwork.sources import records

AT = datetime(2024, 2, 1, tzinfo=UTC)


def raw(spark):
    data = {
        "coingecko_coins_markets": [{"id": "eth", "symbol": "eth", "name": "Ether", "current_price": "oops", "market_cap": 5, "total_volume": 1.5, "price_change_percentage_24h": -2.25,
                                     "market_cap_rank": 1, "ath": 9, "last_updated": "2024-01-01T00:00:00Z"}, {"id": None, "symbol": "x"}],
        "coingecko_coins_detail": [{"id": "eth", "symbol": "eth", "name": "Ether", "description": {"en": "gas"}, "categories": ["a"], "links": {"homepage": ["h"], "repos_url": {"github": ["g"]}},
                                    "genesis_date": "2015-07-30", "developer_data": {"forks": 3, "stars": None}, "community_data": {}}],
        "coingecko_exchanges": [{"id": "ex", "name": "Ex", "year_established": 2000, "country": "nl", "trust_score": 9, "trust_score_rank": 11, "trade_volume_24h_btc": 1, "url": "u"}],
        "defi_llama_protocols": [{"id": "1", "name": "P", "symbol": "ETH", "category": "DeFi", "chains": ["a", "b"], "tvl": None, "change_1d": 0, "change_7d": 0, "audits": 1, "url": "u", "slug": "P-x"}],
        "defi_llama_yields_pools": [{"pool": "p1", "chain": "c", "project": "p-X", "symbol": "s", "tvlUsd": 10, "apy": 2, "apyBase": 1, "apyReward": None, "stablecoin": True}],
        "etherscan_eth_transactions": [{"hash": "h", "blockNumber": b, "timeStamp": "1700000000", "from": "0xBE0EB53F46CD790CD13851D5EFF43D12404D33E8", "to": "B", "value": str(b * 10**18),
                                        "gasUsed": "1", "gasPrice": "2000000000", "isError": None} for b in (1, 2)],
        "etherscan_token_transfers": [{"hash": "t", "blockNumber": "1", "timeStamp": "1", "from": "A", "to": "B", "value": "5000000", "contractAddress": "C", "tokenName": "n", "tokenSymbol": "eth", "tokenDecimal": d}
                                      for d in ("6", None)],
    }
    return {name: records.raw_frame(spark, rows, AT) for name, rows in data.items()}


@pytest.fixture(scope="module")
def frames(spark):
    return project.build(spark, raw(spark))


def one(frames, name):
    found = frames[name].collect()
    assert len(found) == 1, name
    return found[0]


def test_junk_becomes_null_and_keyless_rows_go(frames):
    coin = one(frames, "stg_coingecko__coins_markets")
    assert coin.current_price_usd is None and coin.market_cap_usd == 5 and float(coin.price_change_pct_24h) == -2.25


def test_json_is_taken_out(frames):
    coin = one(frames, "stg_coingecko__coins_detail")
    assert (coin.description, coin.homepage_url, coin.github_url, coin.developer_forks, coin.developer_stars, coin.twitter_followers) == ("gas", "h", "g", 3, None, None)


def test_newest_transaction_stays_and_null_booleans_stay_null(frames):
    tx = one(frames, "stg_etherscan__transactions")
    assert tx.block_number == 2 and float(tx.value_eth) == 2 and float(tx.gas_price_gwei) == 2 and tx.is_error is None
    assert tx.tracked_address == "0xbe0eb53f46cd790cd13851d5eff43d12404d33e8"


def test_case_blind_join_and_default_counts(frames):
    assert one(frames, "int_protocol_metrics").pool_count == 1
    assert one(frames, "fct_daily_token_metrics").whale_tx_count == 0


def test_only_top_venues_are_covered(frames):
    assert frames["int_exchange_token_coverage"].count() == 0


def test_53_data_tests(spark, frames):
    assert len(project.tests) == 53
    bad = {r.test_id: r.failures for r in checks.run_tests(project, frames).filter("status = 'fail'").collect()}
    assert bad == {"test.market.custom_dim_protocols_tvl_usd": 1}


def test_plans_push_filters_and_prune_columns(spark):
    from loomwork.plans.market_queries import model
    from .conftest import SF

    plan = model("stg_coingecko__coins_detail", spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey" in plan and "p_retailprice" not in plan


def test_marts_are_written(spark, tmp_path):
    assert len(project.write(spark, raw(spark), str(tmp_path))) == 6
    assert Versions(spark, str(tmp_path)).read("dim_tokens").count() == 1
    again = raw(spark)
    again["coingecko_coins_detail"] = again["coingecko_coins_detail"].limit(0)
    project.write(spark, again, str(tmp_path))
    store = Versions(spark, str(tmp_path))
    assert (store.read("dim_tokens").count(), store.read("dim_tokens", 1).count()) == (0, 1)
