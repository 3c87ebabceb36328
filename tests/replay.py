"""The rules one call at a time, in plain Python: what the set forms must equal."""


def allocate(requests, seats, cap, rac=0, wl=0):
    """(status, seat, queue number) per request, in order."""
    free, out = sorted(seats), []
    for r in requests:
        if free:
            out.append((r, "Confirmed", free.pop(0), None))
        elif rac < cap:
            rac += 1
            out.append((r, "RAC", None, rac))
        else:
            wl += 1
            out.append((r, "WL", None, wl))
    return out


class Desk:
    """Interleaved bookings and cancellations of one scope."""

    def __init__(self, seats, cap):
        self.free, self.cap = sorted(seats), cap
        self.held, self.queue, self.gone = {}, [], set()

    def place(self, p):
        i = self.queue.index(p) + 1
        return ("RAC", i) if i <= self.cap else ("WL", i - self.cap)

    def status(self, p):
        if p in self.gone:
            return ("cancelled", None)
        return ("Confirmed", None) if p in self.held else self.place(p)

    def book(self, p):
        if self.free:
            self.held[p] = self.free.pop(0)
        else:
            self.queue.append(p)
        return self.status(p)

    def cancel(self, p):
        if p in self.held:
            seat = self.held.pop(p)
            if self.queue:
                self.held[self.queue.pop(0)] = seat
            else:
                self.free = sorted([*self.free, seat])
            self.gone.add(p)
        elif p in self.queue:
            self.queue.remove(p)
            self.gone.add(p)


def wallet(events, balance):
    """(accepted, balance after) per event in cents."""
    out = []
    for kind, cents in events:
        ok = kind != "debit" or balance >= cents
        if ok:
            balance += -cents if kind == "debit" else cents
        out.append((ok, balance))
    return out
