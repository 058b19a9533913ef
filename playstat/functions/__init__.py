from playstat.functions.flags import (listen_plus, rewind_flag, length_bucket4, length_bucket6,
                                      position_third, event_flag, quartile_from_cuts)
from playstat.functions.tails import (erfc, normal_two_sided_p, normal_lower_p, chi2_df1_p,
                                      student_t_two_sided_p, hash_uniform)

__all__ = ["listen_plus", "rewind_flag", "length_bucket4", "length_bucket6", "position_third",
           "event_flag", "quartile_from_cuts", "erfc", "normal_two_sided_p", "normal_lower_p",
           "chi2_df1_p", "student_t_two_sided_p", "hash_uniform"]
