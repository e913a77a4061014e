"""The row-store set: a few portable functions."""

from __future__ import annotations

from larkspur.functions import pg
from larkspur.functions.registry import register

SET = "mysql"
for _n, _f in (("count", pg.count), ("countDistinct", pg.count_distinct), ("countIf", pg.count_if), ("sum", pg.sum), ("avg", pg.avg), ("min", pg.min_), ("max", pg.max_), ("lower", pg.lower), ("upper", pg.upper), ("length", pg.length), ("coalesce", pg.coalesce)):
    register(SET, _n)(_f)
count, count_distinct, count_if, sum, avg, min_, max_, lower, upper, length, coalesce = pg.count, pg.count_distinct, pg.count_if, pg.sum, pg.avg, pg.min_, pg.max_, pg.lower, pg.upper, pg.length, pg.coalesce
