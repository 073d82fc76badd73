from __future__ import annotations

import ipaddress

from lodestream.llm.net import with_canonical_ip


def test_addresses(spark):
    same = {
        "10.0.0.7": ["10.0.0.7", " 10.0.0.7", "10.0.0.7:8080", "::ffff:10.0.0.7", "::FFFF:10.0.0.7", "::ffff:0a00:0007", "10.0.0.7, 10.1.1.1", "[::ffff:10.0.0.7]:443"],
        "2001:db8::7a12": ["2001:db8::7a12", "2001:DB8::7A12", "2001:0db8:0000:0000:0000:0000:0000:7a12", "2001:db8:0:0:0:0:0:7a12", "[2001:db8::7a12]:443", "2001:db8::7a12%eth0"],
        None: [None, "", "-", "unknown", "null", "999.1.1.1", "hello", "1:2:3", "1::2::3", "g::1"],
    }
    rows = [(ipaddress.ip_address(k).exploded if k else None, x) for k, xs in same.items() for x in xs]
    df = with_canonical_ip(spark.createDataFrame(rows, "want string, ip string"), "ip", "got")
    assert [r for r in df.collect() if r.want != r.got] == []
