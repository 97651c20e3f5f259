"""The relational form of simulation results. Sample indices are the keys; times derive from them."""

POPS = "job_id long, pop string, pop_ord int, n_cells long, y_lo double, y_hi double"
CELLS = "job_id long, gid long, pop string"
SPIKES = "job_id long, pop string, gid long, t double"
#: A regularly sampled signal, one row per sample, and one row per channel.
SIGNAL = "job_id long, channel string, y double, i long, t double, v double"
TRACES = "job_id long, channel string, y double, t0 double, dt double, values array<double>"
MASK = "channel string, y double, i long, t double, m int"
INTERVALS = "channel string, state int, t_start double, t_end double"
EVENTS = "channel string, band string, peak_time_s double, start_time_s double, stop_time_s double, duration_s double, peakF double, ncycle double, Foct double, filtsigcor double, event_passed boolean"
