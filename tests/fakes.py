"""State, timers and a clock that tests hold in their hands."""


class Held:
    """A state variable in memory."""

    def __init__(self):
        self.value, self.puts = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value or []) if isinstance(self.value, list) or self.value is None else self.value

    def update(self, value):
        self.value = value

    def put(self, rows):
        self.value, self.puts = list(rows), self.puts + 1

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Held())

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms
