import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.packed import dialect_cost, parses, unpack_values

COMMON = {w: 50 for w in ("镀膜炉", "碳纤织物", "gross margin", "low-noise supply", "R&D", "A/B test", "I/O", "C++")}


def best(text):
    return min(dialect_cost(text, COMMON), key=lambda x: x[0])[1] if parses(text) else ()


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("镀膜炉、碳纤织物、镀膜炉", ("镀膜炉", "碳纤织物", "镀膜炉")),
        (" gross margin ", ("gross margin",)),
        ("A/B test / I/O / R&D", ("A/B test", "I/O", "R&D")),
        ('["镀膜炉", "gross margin"]', ("镀膜炉", "gross margin")),
        ("['gross margin', 'R&D']", ("gross margin", "R&D")),
        ('镀膜炉,"碳纤织物, gross margin",R&D', ("镀膜炉", "碳纤织物, gross margin", "R&D")),
        ('镀膜炉;"""碳纤织物""级"', ("镀膜炉", '"碳纤织物"级')),
        ("“碳纤织物；R&D”；镀膜炉", ("碳纤织物；R&D", "镀膜炉")),
        ("「镀膜炉」|「gross margin|R&D」", ("镀膜炉", "gross margin|R&D")),
        ("• 镀膜炉\r\n• low-noise supply", ("镀膜炉", "low-noise supply")),
        ("- gross margin\n- C++", ("gross margin", "C++")),
        ("#镀膜炉 #gross margin", ("镀膜炉", "gross margin")),
        ("，镀膜炉，，R&D， ", ("镀膜炉", "R&D")),
        ("镀膜炉；碳纤织物|R&D / I/O\tC++", ("镀膜炉", "碳纤织物", "R&D", "I/O", "C++")),
        ("、 ;|", ()),
        ("", ()),
        ('"never closed', ('"never closed',)),
    ],
)
def test_dialects(text, values):
    assert best(text) == values


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab,;、"\'|[]# \n-/', max_size=30))
def test_every_parse_is_clean(text):
    for values in parses(text):
        assert values and all(v and v == v.strip() for v, _ in values)


def test_unpack_on_spark(spark):
    plain = [("text_row", f"r{i}", "镀膜炉、碳纤织物", 1) for i in range(40)]
    rows = [*plain, ("asset_ref", "a", '镀膜炉,"碳纤织物,镀膜炉"', 1), ("asset_ref", "a", '镀膜炉,"碳纤织物,镀膜炉"', 2), ("asset_ref", "b", None, 1), ("asset_ref", "c", " ", 1), ("asset_ref", None, "镀膜炉", 1)]
    got = unpack_values(spark.createDataFrame(rows, "record_kind string, record_id string, packed string, pos int"))
    assert got.count() == 82
    assert sorted((r.pos, r.keyword) for r in got.where("record_kind = 'asset_ref'").collect()) == [(1, "镀膜炉"), (2, "碳纤织物,镀膜炉")]
    long = unpack_values(spark.createDataFrame([("text_row", "x", "、".join(["镀膜炉"] * 20000))], "record_kind string, record_id string, packed string"))
    assert long.count() == 20000
    assert unpack_values(spark.createDataFrame([], "record_kind string, record_id string, packed string")).count() == 0
