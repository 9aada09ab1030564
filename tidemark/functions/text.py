"""Column functions on text and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EVM_CHAINS = ("arbitrum", "ethereum")
#: Words that count for or against.
BULLISH = ("moon", "bullish", "long", "buy", "pump", "breakout", "accumulate")
BEARISH = ("dump", "bearish", "short", "sell", "crash", "rug", "exit")
#: Fixed patterns of entities in posts.
CASHTAG = r"\$([A-Z]{2,10})\b"
SOL_DOMAIN = r"(?i)\b([\w-]{2,32}\.sol)\b"
ETH_ADDRESS = r"\b(0x[a-fA-F0-9]{40})\b"
BTC_BECH32 = r"(?i)\b(bc1[a-z0-9]{25,62})\b"
BTC_LEGACY = r"\b([13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"
SOL_ADDRESS = r"\b([1-9A-HJ-NP-Za-km-z]{32,44})\b"
URL = r"(?i)(https?://[^\s]+)"


def normalize_address(address: Column, chain: Column) -> Column:
    return F.when(chain.isin(*EVM_CHAINS), F.lower(address)).otherwise(address)


def handle(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), "^@", "")
    return F.when(bare.rlike(r"^[a-zA-Z0-9_]{1,15}$"), F.lower(bare))


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur as substrings."""
    low = F.lower(text)
    out = F.lit(0)
    for w in words:
        out = out + F.contains(low, F.lit(w)).cast("int")
    return out


def entities(text: Column) -> Column:
    """Distinct (kind, value) of a text. A cashtag also gives a symbol; names whose case says nothing are in lower
    case; what could be an older bitcoin address is no solana address."""

    def all_of(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def tagged(kind: str, values: Column, lower: bool = False) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), (F.lower(v) if lower else v).alias("value")))

    whole = "^" + BTC_LEGACY.replace(r"\b", "") + "$"
    solana = F.filter(all_of(SOL_ADDRESS), lambda v: ~v.startswith("0x") & ~v.rlike(whole))
    found = [
        tagged("cashtag", all_of(CASHTAG)), tagged("symbol", all_of(CASHTAG)), tagged("sol_domain", all_of(SOL_DOMAIN), True), tagged("eth_address", all_of(ETH_ADDRESS), True),
        tagged("btc_address", all_of(BTC_BECH32), True), tagged("btc_address", all_of(BTC_LEGACY)), tagged("sol_address", solana), tagged("url", all_of(URL)),
    ]
    return F.array_distinct(F.concat(*found))


def wallet_tier(win_rate: Column, trades: Column, hold_hours: Column, least_win_rate: float) -> tuple[Column, Column]:
    """Kind and confidence of a wallet by its record. Fixed values."""
    few, smart, some = trades < 10, (win_rate >= least_win_rate) & (hold_hours >= 2), win_rate >= 0.25
    kind = F.when(few, "whale").when(smart, "smart_money").when(some, "kol").otherwise("whale")
    confidence = F.when(few, 0.3).when(smart, F.least(F.lit(0.95), 0.5 + win_rate * 0.5)).when(some, 0.45).otherwise(0.35)
    return kind, confidence


def _labelled(score: Column, high: str, low: str, middle: str) -> Column:
    return F.when(score >= 2, high).when(score <= -2, low).otherwise(middle)


def stack_label(*signals: Column) -> Column:
    """The label of a sum of signals, each -1, 0 or 1. Fixed values."""
    total = sum(signals[1:], signals[0])
    return _labelled(total, "Constructive", "Defensive", "Neutral / mixed")


def headline(weekly_return: Column, share_up: Column) -> Column:
    """Both over or both under their bounds decide. A null counts as neither. Fixed values."""
    sign = lambda c, lo, hi: F.when(c > hi, 1).when(c < lo, -1).otherwise(0)
    return _labelled(sign(weekly_return, -0.02, 0.02) + sign(share_up, 0.45, 0.55), "Risk-on", "Risk-off", "Mixed")


def parse_number(c: Column) -> Column:
    """(1,234.5) is negative; '-', '.', and blanks are null."""
    t = F.trim(c)
    digits = F.regexp_replace(t, r"[(),$%\s]", "")
    value = digits.try_cast("double")
    return F.when(t.isin("", "-", ".", "–"), None).when(t.startswith("(") & t.endswith(")"), -value).otherwise(value)


def wei(c: Column, unit: Column | None = None) -> Column:
    """Ether from a value in wei, gwei or ether; without a unit, from 1e9 on it is wei."""
    v = c.try_cast("double")
    guess = F.when(v >= 1e9, v / 1e18).otherwise(v)
    return guess if unit is None else F.when(unit == "wei", v / 1e18).when(unit == "gwei", v / 1e9).when(unit == "eth", v).otherwise(guess)
