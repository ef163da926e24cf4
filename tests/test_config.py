import pytest

from stratavox.operators.combine import check_same_atlas
from stratavox.operators.mapping import natural_key
from stratavox.plans.config import Box, CellCounting, Chunks, Config, Registration, Span, VisualCheck


def test_defaults():
    c = Config()
    assert c.chunks.shape() == (500, 500, 500) and c.cell_counting.threshd_value == 100 and c.registration.downsample_rough == (3, 6, 6)
    assert c.tuning_trim.slices() == (slice(0, 100), slice(0, 2000), slice(0, 2000)) and c.visual_check.cellcount_trim.z == Span(500, 510)


@pytest.mark.parametrize(
    "make",
    [
        lambda: CellCounting(dog_sigma1=4, dog_sigma2=1),
        lambda: CellCounting(min_threshd_size=5, max_threshd_size=1),
        lambda: CellCounting(min_wshed_size=5, max_wshed_size=5),
        lambda: CellCounting(tophat_radius=0),
        lambda: Registration(ref_orientation=(1, 1, 3)),
        lambda: Registration(downsample_fine=(1.2, 1, 1)),
        lambda: Registration(downsample_fine=(0, 1, 1)),
        lambda: Registration(lower_bound=6000),
        lambda: Registration(lower_bound_mapto=200),
        lambda: Registration(reg_trim=Box(z=Span(-5))),
        lambda: Registration(reg_trim=Box(y=Span(0, 10, 2))),
        lambda: Chunks(z=0),
        lambda: VisualCheck(heatmap_raw_radius=-1),
        lambda: Config.from_dict({"chunks": 5}),
    ],
)
def test_refused(make):
    with pytest.raises(ValueError):
        make()


def test_yaml_round_trip_ignores_unknown_keys(tmp_path):
    c = Config.from_dict({"chunks": {"z": 10, "other": 1}, "registration": {"ref_orientation": {"z": -2, "y": 1, "x": 3}, "downsample_rough": [2, 2, 2], "reg_trim": {"z": {"start": 4}}}, "new": {}})
    assert c.chunks.shape() == (10, 500, 500) and c.registration.ref_orientation == (-2, 1, 3) and c.registration.downsample_rough == (2, 2, 2) and c.registration.reg_trim.z.start == 4
    c.write(str(tmp_path / "c.yaml"))
    assert Config.read(str(tmp_path / "c.yaml")) == c


def test_natural_order():
    assert sorted(["img2", "img10", "img1"], key=natural_key) == ["img1", "img2", "img10"]


def test_atlas_must_agree():
    check_same_atlas({"a": {"version": 1}, "b": {"version": 1}})
    with pytest.raises(ValueError, match="different atlases"):
        check_same_atlas({"a": {"version": 1}, "b": {"version": 2}})
