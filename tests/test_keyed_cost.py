"""How often keyed state is asked, without Spark."""

from fluxwarden.streaming import keyed


class Store:
    """A state that counts the look-ups of keys and the values put into it."""

    def __init__(self):
        self.known, self.asked, self.values = {}, 0, []

    def exists(self):
        return True

    def containsKey(self, key):
        self.asked += 1
        return key in self.known

    def updateValue(self, key, value):
        self.known[key] = value

    def appendList(self, values):
        self.values += values

    def appendValue(self, value):
        self.values.append(value)

    def registerTimer(self, at):
        self.at = at


def test_first_seen_asks_once_for_a_value():
    p = keyed.FirstSeen(None)
    p.known, p.last = Store(), Store()
    p.known.known["b",] = (0,)
    out = list(p.steps("a", [(t, t, "ab"[t % 2]) for t in range(1, 101)]))
    assert [r.id for r in out if r.new] == [2] and p.known.asked == 2


def test_waiting_rows_are_kept_by_pages():
    p = keyed.Newest(3, 60)
    p.waiting, p.handle = Store(), Store()
    assert not list(p.handleInputRows(("a",), (("a", 5000 + t, t) for t in range(2 * keyed.PAGE + 1)), None))
    assert len(p.waiting.values) == 3 and p.handle.at == 6
