"""Sequential models written from the behaviour description, one event at a time.

They share no code with the package; the tests compare them with the distributed forms.
"""

from __future__ import annotations

import math


class WindowedDetector:
    """Change detector over buckets kept as {level: [sum, ...]}, oldest sum first."""

    def __init__(self):
        self.buckets = {0: []}
        self.n = 0
        self.sum = 0.0
        self.spread = 0.0
        self.fed = 0

    def mean(self):
        return self.sum / self.n if self.n else 0.0

    def feed(self, x, delta):
        self.fed += 1
        self.n += 1
        self.sum += x
        self.spread += (x - self.mean()) ** 2
        self.buckets[0].append(x)
        level = 0
        while len(self.buckets[level]) == 6:
            first, second = self.buckets[level].pop(0), self.buckets[level].pop(0)
            self.buckets.setdefault(level + 1, []).append(first + second)
            level += 1
        changed = False
        if self.fed % 32 == 0 and self.n > 10:
            while self.differs(delta):
                changed = True
                oldest = max(k for k, v in self.buckets.items() if v)
                self.sum -= self.buckets[oldest].pop(0)
                self.n -= 2 ** oldest
        return changed

    def differs(self, delta):
        left_n, left_sum, right_n, right_sum = 0, 0.0, self.n, self.sum
        for level in sorted(self.buckets):
            for part in self.buckets[level]:
                left_n, right_n = left_n + 2 ** level, right_n - 2 ** level
                left_sum, right_sum = left_sum + part, right_sum - part
                if left_n > 5 and right_n > 5:
                    m = 1.0 / left_n + 1.0 / right_n
                    log = math.log(2 / delta)
                    cut = math.sqrt(2 * m * (self.spread / self.n) * log) + (2.0 / 3.0) * m * log
                    if abs(left_sum / left_n - right_sum / right_n) > cut:
                        return True
        return False


def adwin_slack(rows, sample, limit, step, floor, warm_cap, cap, warm_buffer, buffer, start):
    """[(event id, slack after, drift, watermark before)] with a watermark emitted on every event."""
    newest = wm = None
    slack, delta, late, total, warm = start, 1.0, 0, 0, []
    detector, out = WindowedDetector(), []
    for event_id, event, arrival in rows:
        before, drift = wm, False
        if sample == "network":
            lateness = max(0, arrival - event)
        else:
            lateness = 0 if newest is None else max(0, newest - event)
        newest = event if newest is None else max(newest, event)
        if len(warm) < 500:
            warm.append(lateness)
            if len(warm) == 500:
                slack = min(warm_cap, max(floor, sum(warm) // 500 + warm_buffer))
        else:
            total += 1
            drift = detector.feed(min(2.0, lateness / slack), delta)
            if drift:
                rate = late / total
                if late == 0:
                    delta = min(1.0, delta + step)
                if rate < limit:
                    late = total = 0
                else:
                    slack = min(cap, max(floor, int(detector.mean() * slack) + buffer))
                    delta = max(0.01, delta - step)
            elif wm is not None and event < wm:
                late += 1
        if len(warm) == 500 and (wm is None or newest - slack > wm):
            wm = newest - slack
        out.append((event_id, slack, drift, before))
    return out


def mean_shift_slack(rows, sample, start, threshold, buffer, floor, cap):
    newest, slack, buffered, out = None, start, [], []
    for event_id, event, arrival in rows:
        if sample == "network":
            buffered.append(arrival - event)
        elif newest is not None:
            buffered.append(max(0, newest - event))
        newest = event if newest is None else max(newest, event)
        buffered = buffered[-200:]
        if len(buffered) == 200 and abs(sum(buffered[:100]) / 100 - sum(buffered[100:]) / 100) > threshold:
            slack = sum(buffered) // 200 + buffer
            slack = min(cap, slack if floor is None else max(floor, slack))
        out.append((event_id, slack))
    return out


def per_tick_windows(rows, window, lateness, propose, tick_ms=200):
    """Replay with a watermark per tick. ``propose(prefix)`` gives the watermark after a list of rows.

    Returns ({(key, end): count} of fired windows, number of dropped events).
    """
    wm, tick, seen, open_windows, fired, dropped = None, None, [], {}, {}, 0

    def advance():
        nonlocal wm
        proposed = propose(seen)
        if proposed is not None and (wm is None or proposed > wm):
            wm = proposed
        for place in [p for p in open_windows if wm is not None and p[1] - 1 + lateness <= wm]:
            fired[place] = open_windows.pop(place)

    for event_id, key, event, arrival in rows:
        if tick is not None and arrival // tick_ms != tick:
            advance()
        tick = arrival // tick_ms
        seen.append((event_id, event, arrival))
        end = (event // window + 1) * window
        if wm is not None and end - 1 + lateness <= wm:
            dropped += 1
        else:
            open_windows[(key, end)] = open_windows.get((key, end), 0) + 1
    advance()
    return fired, dropped
