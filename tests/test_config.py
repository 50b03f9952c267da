import pytest

from nearspark.plans import config as C


def test_inferred_values():
    for n in (1, 2, 63, 128, 5_000, 77_777, 300_000, 12_345_678):  # a power of two near the root, with 64 rows a list at least
        k = C.infer_nlist(n)
        assert k & (k - 1) == 0 and (k == 1 or 64 * k <= n) and k <= 2 * n**0.5
        assert k == 1 or 128 * k > n or abs(k - n**0.5) <= min(abs(2 * k - n**0.5), abs(k / 2 - n**0.5))
    with pytest.raises(ValueError):
        C.infer_nlist(0)
    for n, lists in ((500, 7), (200_000, 100), (9_000_000, 200_000)):
        assert C.training_count(n, lists) == min(n, max(65_536, 64 * lists))
    for lists, n, k in ((32, 3_200, 4), (300, 90_000, 25), (4_096, 500_000, 100)):
        base = min(lists, max(8, -(-lists // 16), -(-4 * k // -(-n // lists))))
        assert C.infer_nprobe(lists, n, k) == base == C.infer_nprobe(lists, n, k, matching=n + 1)
        assert C.infer_nprobe(lists, n, k, matching=0) == 1
        assert C.infer_nprobe(lists, n, k, matching=n // 3) == min(lists, -(-base * n // (n // 3)))
        assert C.infer_nprobe(lists, n, k, matching=n // 3, cap=2) == min(2 * base, C.infer_nprobe(lists, n, k, matching=n // 3))
        with pytest.raises(ValueError):
            C.infer_nprobe(lists, n, k, matching=n // 3, cap=0)
    for d in (64, 65, 700):  # the most bits whose planes and factors fit
        for budget in (40, 150, 500):
            sizes = {b: -(-d // 64) * 8 * b + (8 if b == 1 else 20) for b in range(1, 9)}
            fit = [b for b, s in sizes.items() if s <= budget]
            if fit:
                assert C.infer_rq_bits(d, budget) == max(fit)
            else:
                with pytest.raises(ValueError):
                    C.infer_rq_bits(d, budget)
    for d, bits, ratio in ((48, 8, 0.0625), (300, 4, 0.0625), (33, 8, 0.25)):
        assert abs(C.infer_pq_m(d, bits, ratio) - d * 32 * ratio / bits) <= 0.5
        assert d % C.infer_uniform_pq_m(d, bits, ratio) == 0
    assert C.nlist_for_partition(1000, 30) == 33 and C.nlist_for_partition(10, 0) == 10


def test_options():
    c = C.IndexConfig.from_options({" index.type ": "ivf_flat", "dimension": "8", "metric": "l2", "nlist": "4"})
    assert c.nlist == 4
    base = {"index.type": "ivf_pq", "dimension": "16", "metric": "l2", "nlist": "4"}
    assert C.BuildPlan.from_options(base | {"target-recall": "0.95"}).config.use_opq
    for bad in ({"pq.m": "5"}, {"pq.m": "0"}, {"pq.bits": "4"}, {"surprise": "1"}, {"metric": "L2"}, {"max-build-seconds": "5"}):
        with pytest.raises(ValueError):
            C.IndexConfig.from_options(base | bad)
    for bad in ({"k": 0}, {"k": 1, "max_filter_expansion": 0}):
        with pytest.raises(ValueError):
            C.SearchParams(**bad)
    with pytest.raises(ValueError):
        C.IndexConfig.from_options({"index.type": "ivf_rq", "dimension": "8", "metric": "l2", "nlist": "1", "rq.bits": "0"})
    assert C.recommend_index(10) == "ivf_flat" and C.recommend_index(10**6, 16) == "ivf_pq" and C.recommend_index(10**6, recall=0.97) == "diskann"
