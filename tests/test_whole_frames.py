from tintmill.plans import registry
from tintmill.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_every_pixel_is_named(spark):
    named = registry.queries()["colour_names_whole"](spark, SF)
    pixels = fixtures.scenes(spark, SF).select("frame_id", "idx")
    assert pixels.filter("idx >= 64").count() > 0
    assert named.count() == pixels.count() and pixels.exceptAll(named.select("frame_id", "idx")).count() == 0
