"""The named factor templates of a spot and perpetual panel, as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import pointwise as X
from panelwright.functions import window as T

#: Fields whose ratio of two sides becomes a net share.
NETS = ("toptrader_account", "toptrader_position", "global_account", "taker_flow")


def templates(df: DataFrame) -> DataFrame:
    """The 18 named factor templates and the taker flow as compositions of operators, on a panel's fields; one level of columns each."""
    w, c = T.series(), F.col
    premium = lambda a, b: X.sub(X.div(c(a), c(b)), F.lit(1.0))
    df = df.withColumns({
        "basis_trade_spot": premium("perp_close", "spot_close"), "basis_mark_index": premium("mark_close", "index_close"), "trade_mark_spread": premium("perp_close", "mark_close"),
        "open_interest_change_1bar": T.ts_return(c("open_interest_base"), 1, w), "open_interest_change_24h": T.ts_return(c("open_interest_base"), 24, w),
        **{f"{n}_net": X.bounded_ratio(c("taker_long_short_volume_ratio" if n == "taker_flow" else f"{n}_long_short_ratio")) for n in NETS},
        **{f"{m}_taker_buy_share": X.div(c(f"{m}_taker_buy_quote_volume"), c(f"{m}_quote_volume")) for m in ("spot", "perp")},
        **{f"{m}_quote_volume_24h": T.ts_sum(c(f"{m}_quote_volume"), 24, w) for m in ("spot", "perp")},
        **{f"{m}_log_return_1bar": X.log(X.div(c(f"{m}_close"), T.ts_delay(c(f"{m}_close"), 1, w))) for m in ("spot", "perp")},
    })
    return df.withColumns({
        "basis_change_1bar": T.ts_delta(c("basis_trade_spot"), 1, w), "perp_to_spot_quote_volume": X.div(c("perp_quote_volume_24h"), c("spot_quote_volume_24h")),
        "spot_perp_return_spread_1bar": X.sub(c("perp_log_return_1bar"), c("spot_log_return_1bar")),
        "perp_realized_vol_24h": X.mul(T.ts_std(c("perp_log_return_1bar"), 24, w), F.sqrt(F.lit(8766.0))),
    })
