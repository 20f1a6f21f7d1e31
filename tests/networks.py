"""Public KONECT networks as text: Zachary's karate club (undirected) and rhesus grooming (directed)."""

KARATE = """
1-2 1-3 2-3 1-4 2-4 3-4 1-5 1-6 1-7 5-7 6-7 1-8 2-8 3-8 4-8 1-9 3-9 3-10 1-11 5-11 6-11 1-12 1-13 4-13 1-14 2-14 3-14 4-14 6-17 7-17 1-18 2-18 1-20
2-20 1-22 2-22 24-26 25-26 3-28 24-28 25-28 3-29 24-30 27-30 2-31 9-31 1-32 25-32 26-32 29-32 3-33 9-33 15-33 16-33 19-33 21-33 23-33 24-33 30-33
31-33 32-33 9-34 10-34 14-34 15-34 16-34 19-34 20-34 21-34 23-34 24-34 27-34 28-34 29-34 30-34 31-34 32-34 33-34
"""

RHESUS = """
1-2 1-3 4-2 5-6 5-7 5-8 5-3 5-9 5-10 5-11 5-12 5-13 5-14 6-1 6-5 6-8 6-3 6-10 6-12 6-15 7-5 7-8 7-2 7-9 7-14 16-2 16-3 16-9 16-11 16-12 16-15 8-6 8-7
2-1 2-4 2-16 2-3 2-9 2-10 2-11 2-12 2-15 3-1 3-2 3-9 3-10 3-11 3-12 3-15 3-13 9-2 9-3 9-11 9-15 9-13 9-14 10-1 10-5 10-6 10-2 10-3 10-9 10-11 10-12
10-15 10-13 11-1 11-5 11-16 11-2 11-3 11-9 11-10 11-15 11-13 12-5 12-6 12-8 12-2 12-3 12-10 12-11 12-15 12-13 12-14 15-4 15-16 15-2 15-3 15-10 15-11
15-12 15-14 13-1 13-5 13-3 13-9 13-10 13-11 13-12 13-15 14-4 14-7 14-8 14-2 14-3 14-9 14-10 14-12 14-15 14-13
"""


def edges(text):
    return [tuple(e.split("-")) for e in text.split()]


DEMO7 = "A-B A-C B-C B-D D-E D-F D-G E-F F-G"
TRI7 = "A-B C-A B-C B-D D-E D-A D-G E-F F-D"
BANDIT5 = [(1, 2, 0.6), (1, 3, 0.1), (1, 4, 0.3), (2, 4, 0.7), (2, 5, 0.2), (2, 3, 0.1), (3, 5, 0.9), (3, 4, 0.1), (4, 5, 0.9), (5, 1, 0.1)]
