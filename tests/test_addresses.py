"""Addresses and network lists against the standard library's."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.functions.addresses import NetworkIndex, address_bits

ODD = [
    None, "", " ", "::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1::2::3", ":::", ":", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::ffff:1.2.3.4", "64:ff9b::10.0.0.1", "::1.2.3", "::1.2.3.256", "1.2.3.4::",
    "1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.4.5", "255.255.255.255", "0.0.0.0", " 10.0.0.1\t", "[::1]", "[FE80::1%eth0]", "fe80::1%eth0", "FFFF:ffff:FFFF:ffff:FFFF:ffff:FFFF:ffff", "localhost", "LOCALHOST ", "127.0.0.1", "169.254.169.254", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
]


def number(text):
    value = (text or "").strip().lower().split("%", 1)[0]
    try:
        ip = ipaddress.ip_address(value[1:-1] if value.startswith("[") and value.endswith("]") else value)
    except ValueError:
        return None
    return int(ip) + (0xFFFF << 32 if ip.version == 4 else 0)


def some(r):
    if r.random() < 0.4:
        return ".".join(str(r.choice([0, 10, 127, 172, 16, 192, 255, r.randrange(256)])) for _ in range(4))
    ip = ipaddress.IPv6Address(r.choice([r.getrandbits(128), r.getrandbits(16), 0xFD << 120 | r.getrandbits(20), 0xFFFF << 32 | r.getrandbits(32), r.getrandbits(64) << 64]))
    return r.choice([str(ip), ip.exploded, str(ip).upper()])


def test_bits_are_the_address(spark):
    r = random.Random(1)
    texts = ODD + [some(r) for _ in range(500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", address_bits(F.col("t")).alias("b")).collect()
    for x in rows:
        got = None if x["b"] is None else (x["b"]["hi"] + (1 << 63) << 64) + x["b"]["lo"] + (1 << 63)
        assert got == number(texts[x["i"]]), texts[x["i"]]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_networks_against_the_library(spark, n):
    r = random.Random(n)
    nets = []
    for _ in range(n):
        ip = some(r)
        nets.append(f"{ip}/{r.randint(4, 32) if '.' in ip and ':' not in ip else r.randint(8, 128)}")
    nets += ["0.0.0.0/32", "::/128", "ffff::/16"] if n > 1 else []
    spans = [(number(str(x.network_address)), number(str(x.broadcast_address))) for x in (ipaddress.ip_network(t, strict=False) for t in nets)]
    texts = ODD + [some(r) for _ in range(400)] + [t.split("/")[0] for t in nets[:300]]
    index = NetworkIndex.of(nets)
    assert all(a[1] + 1 < b[0] for a, b in zip(index.intervals, index.intervals[1:]))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", index.holds(address_bits(F.col("t"))).alias("in")).collect()
    for x in rows:
        at = number(texts[x["i"]])
        assert x["in"] == (at is not None and any(a <= at <= b for a, b in spans)), texts[x["i"]]


def test_blocked_addresses_are_those_of_the_row_check(spark):
    r = random.Random(3)
    texts = ODD + [some(r) for _ in range(500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", urls.is_blocked_ip(F.col("t")).alias("b")).collect()
    assert {texts[x["i"]]: x["b"] for x in rows} == {t: urls.blocked_address(t) for t in texts}


def test_no_python_in_the_plan(spark, capsys):
    spark.createDataFrame([("1.2.3.4",)], "t string").select(urls.is_blocked_ip(F.col("t"))).explain()
    assert "Python" not in capsys.readouterr().out


def test_an_index_is_bounded(spark):
    nets = spark.range(20).select(F.concat(F.lit("10.0."), F.col("id") * 2, F.lit(".0/24")).alias("n"))
    assert len(NetworkIndex.of_table(nets, "n").intervals) == 20
    with pytest.raises(ValueError):
        NetworkIndex.of_table(nets, "n", most=19)
