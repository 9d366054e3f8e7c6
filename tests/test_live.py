"""Stateful stream operators, batch by batch, against the whole table."""

import datetime

import numpy as np
import pandas as pd

from marketframe.streaming import live

DAY = datetime.date(2020, 1, 1)


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class _Map(dict):
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class _Handle:
    """The state of one key."""

    def __init__(self):
        self.timers, self.states = [], {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, _Map())

    def registerTimer(self, at):
        self.timers.append(at)


def _run(processor, key, batches):
    handle = _Handle()
    processor.init(handle)
    out = [pd.concat(list(processor.handleInputRows(key, iter([b]), None)), ignore_index=True) for b in batches]
    return out, handle


def _averages(closes: pd.Series) -> pd.DataFrame:
    ewm = lambda x, s: x.ewm(span=s, adjust=False).mean()
    macd = ewm(closes, 12) - ewm(closes, 26)
    return pd.DataFrame({"ema_50": ewm(closes, 50), "macd": macd, "macd_signal": ewm(macd, 9), "macd_hist": macd - ewm(macd, 9)})


def _bars(offsets, closes):
    return pd.DataFrame({"symbol": "A", "date": [DAY + datetime.timedelta(days=int(d)) for d in offsets], "close": closes})


def test_late_rows_give_the_batch_answer():
    rng = np.random.default_rng(1)
    offsets = rng.permutation(300)
    closes = 100 + rng.normal(0, 1, 300).cumsum()
    batches = [_bars(offsets[i:i + 60], closes[i:i + 60]) for i in range(0, 300, 60)]
    batches.append(_bars([7, 200], [50.0, 70.0]))  # corrections
    out, handle = _run(live.LiveAverages(), ("A",), batches)
    table = pd.concat(out).drop_duplicates("date", keep="last").set_index("date").sort_index()
    want = pd.concat(batches).drop_duplicates("date", keep="last").set_index("date").sort_index()["close"]
    assert len(table) == 300 and set(table.status) == {"new", "changed"}
    assert np.abs(table[["ema_50", "macd", "macd_signal", "macd_hist"]].to_numpy(float) - _averages(want).to_numpy()).max() < 1e-9
    assert len(handle.states["blocks"]) <= live.KEEP_BLOCKS


def test_old_blocks_go_and_every_row_comes_out():
    n = live.BLOCK_DAYS * (live.KEEP_BLOCKS + 4)
    closes = 100 + np.random.default_rng(2).normal(0, 1, n).cumsum()
    first, second = n // 3, 2 * n // 3
    batches = [_bars(range(first), closes[:first]), _bars(range(first, second), closes[first:second]), _bars(range(second, n), closes[second:]),
               pd.DataFrame({"symbol": "A", "date": [DAY, DAY + datetime.timedelta(days=n), DAY + datetime.timedelta(days=n), None, DAY],
                             "close": [1.0, 2.0, 3.0, 4.0, None]})]
    out, handle = _run(live.LiveAverages(), ("A",), batches)
    assert len(handle.states["blocks"]) == live.KEEP_BLOCKS and handle.states["base"].exists()
    assert out[3].status.value_counts().to_dict() == {"late": 1, "replaced": 1, "incomplete": 2, "new": 1}
    want = _averages(pd.Series([*closes, 3.0]))
    got = pd.concat(out)
    got = got[got.status.isin(["new", "changed"])].drop_duplicates("date", keep="last").sort_values("date")
    assert np.abs(got[["ema_50", "macd", "macd_signal", "macd_hist"]].to_numpy(float) - want.to_numpy()).max() < 1e-9


def test_latest_articles_are_bounded():
    rng = np.random.default_rng(3)
    at, score = rng.permutation(500) // 2, rng.normal(0, 1, 500)
    news = pd.DataFrame({"symbol": "A", "date": DAY, "at": at, "article_id": range(500), "score": score})
    out, handle = _run(live.LatestArticles(20, 7), ("A", DAY), [news[i:i + 50] for i in range(0, 500, 50)] + [news[:50]])
    want = news.sort_values(["at", "article_id"]).tail(20).score.mean()
    assert abs(out[-1].sentiment_score[0] - want) < 1e-12 and out[-1].n[0] == 20
    assert [len(x) for x in handle.states["kept"].get()] == [20, 20, 20] and len(handle.timers) == 1
    few, _ = _run(live.LatestArticles(20, 7), ("A", DAY), [news[:3], news[:3]])
    assert few[-1].n[0] == 3
