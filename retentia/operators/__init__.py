"""DataFrame-in, DataFrame-out operators grouped by SURVEY section: derive (B), quality (A/C), profile (D), ranking (E), metrics (D12-D17), model (I), retrieve (J1-J5), recommend."""
