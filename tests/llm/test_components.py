"""Components from links in one go and in parts."""

import random

from waveframe.llm.components import components, extended


def brute(links):
    label = {x: x for link in links for x in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_parts_equal_the_whole(spark):
    random.seed(2)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    random.shuffle(links)
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    assert dict(map(tuple, components(frame(links)).collect())) == brute(links)
    labels = None
    for k in range(0, len(links), 20):
        labels = extended(labels, frame(links[k : k + 20]))
    labels = extended(labels, frame(links[:3]))
    assert dict(map(tuple, labels.collect())) == brute(links)
    assert components(frame([])).count() == 0
